"""Items of pages whose fields are labelled or stand between delimiters under named columns, with the place of every value.

A page is read line by line: headings of columns, rows below them, labelled items with
their continuations. What a line is depends on the last heading or item above it and
on whether every line between them fits; both are windows over one partitioning by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import measure_kind
from ledgerloom.operators.durable import roomy

#: Names of columns and labels, and what a table must have.
ALIASES = {
    "partida": "item", "item": "item", "ítem": "item", "descripción": "description", "descripcion": "description", "cantidad": "quantity", "quantity": "quantity", "unidad": "unit", "unit": "unit",
    "marca": "brand", "brand": "brand", "modelo": "model", "model": "model",
}
NEEDED, MOST = ("item", "description", "quantity", "unit"), 6
#: Labelled items, what they are to be, labelled fields, numbers, and lines of contents.
ITEM, ACTION = r"(?iu)^(?:PARTIDA|ITEM|ÍTEM)\s*:?[ \t]*(\d+(?:\.\d+)*)\s*:?[ \t]*", r"(?iu)^(suministro\b|suministrar\b|servicio de\b|prestaci[oó]n de\b|entrega de\b|entregar\b)"
LABEL = r"(?iu)^(marca|brand|modelo|model|cantidad|quantity|unidad|unit)\s*:\s*(.+)$"
NUMBER, AMOUNT, CONTENTS = r"^\d+(?:\.\d+)*$", r"^\d+(?:\.\d+)?$", r"\.{3,}\s*\d+\s*$"

#: Characters of text of one task: its lines are sorted some ten times, which takes some 200 bytes of memory a character in all (measured).
CHARS = 1_000_000


def bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def lead_of(x: Column) -> Column:
    """Characters of white space at the beginning."""
    return F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))


def role_of(x: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv]), F.lower(x))


def domain_of(x: Column) -> Column:
    """SUPPLY, DELIVERABLE or SERVICE by the action that a text begins with; null without one."""
    verb = F.lower(F.regexp_extract(x, ACTION, 1))
    return F.when(verb.isNull() | (verb == ""), None).when(verb.startswith("suministr"), "SUPPLY").when(verb.startswith("entreg"), "DELIVERABLE").otherwise("SERVICE")


def cells_of(x: Column, at: Column, delimiter: Column) -> Column:
    """(text, start, end) of a line's parts, trimmed; `at` is where the line begins."""
    parts = F.split(x, F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")))
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p) + 1)
    return F.transform(parts, lambda p, i: F.struct(bare(p).alias("text"), (at + before(i) + F.when(bare(p) == "", 0).otherwise(lead_of(p))).alias("start"), (at + before(i) + F.when(bare(p) == "", 0).otherwise(lead_of(p)) + F.length(bare(p))).alias("end")))


def _spec(role: Column, text: Column, start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), role.alias("role"), text.alias("text"))


def structured_blocks(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, occurrence, item, domain, state, fields, places) of the items of pages, numbered from 0 in a page.

    A table has a heading of four to six different columns, item, description, quantity
    and unit among them, between bars or tabs; rows follow while they have as many cells, a
    numbered item, a description, a plain amount and a known unit. The first line that
    doesn't fit ends it. A labelled item begins with its label and number, and an
    action stands behind it, or on the next line if nothing does; fields labelled behind
    bars or on the lines below, and indented lines, belong to it. Headings and rows of
    tables are no continuations. An item whose values hold a question or a line of
    contents is left out; several values of one field but the description make it
    AMBIGUOUS. places are [start, end) in the page's text, headings under `header_`
    roles. Lines end at LF; a CR before it is no part of them. Null pages have none;
    keys must tell pages apart.
    """
    page = Window.partitionBy(*keys).orderBy("no")
    upto, before = page.rowsBetween(Window.unboundedPreceding, 0), page.rowsBetween(Window.unboundedPreceding, -1)
    some = roomy(pages.where(F.col(text).isNotNull()).select(*keys, text), keys, F.length(text), CHARS)
    rows = some.select(*keys, F.posexplode(F.split(text, "\n")).alias("no", "full"))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("full") + 1).over(before), F.lit(0))).withColumn("raw", F.regexp_replace("full", r"\r+$", "")).drop("full")
    raw, at = F.col("raw"), F.col("at")
    delimiter = F.when(F.contains(raw, F.lit("|")), "|").when(F.contains(raw, F.lit("\t")), "\t")
    few = F.size(F.split(raw, r"[|\t]")) <= 4 * MOST
    rows = rows.withColumns({"line": bare(raw), "delimiter": delimiter, "cells": F.when(delimiter.isNotNull() & few, cells_of(raw, at, delimiter))})
    rows = rows.withColumn("roles", F.transform("cells", lambda c: role_of(c["text"])))
    roles = F.col("roles")
    heading = F.forall(roles, lambda r: r.isNotNull()) & (F.size(F.array_distinct(roles)) == F.size(roles)) & F.forall(F.lit(list(NEEDED)), lambda r: F.array_contains(roles, r))
    numbered = F.col("line").rlike(ITEM)
    mark = F.regexp_extract("line", ITEM, 0)
    rows = rows.withColumns({"heading": F.coalesce(heading, F.lit(False)), "numbered": numbered, "mark": mark, "empty": numbered & (bare(F.substring(F.col("line"), F.length(mark) + 1, F.length("line"))) == "")})
    # an empty item takes the next line as its text, whatever that is; of items that follow each other empty, every second one is taken
    run = F.col("no") - F.row_number().over(Window.partitionBy(*keys, "empty").orderBy("no"))
    rows = rows.withColumn("run", run)
    odd = F.row_number().over(Window.partitionBy(*keys, "empty", "run").orderBy("no")) % 2 == 1
    rows = rows.withColumn("opens", F.col("empty") & odd).withColumn("taken", F.coalesce(F.lag("opens").over(page), F.lit(False)))
    head = F.col("heading") & ~F.col("taken")
    rows = rows.withColumn("head", head).withColumn("h", F.last(F.when(F.col("head"), F.struct("no", "delimiter", "roles", "cells")), ignorenulls=True).over(upto))
    cell = lambda role: F.get(F.col("cells"), F.array_position("h.roles", role).cast("int") - 1)["text"]
    shaped = (F.col("delimiter") == F.col("h.delimiter")) & (F.size("cells") == F.size("h.roles")) & ~F.col("taken") & ~F.col("head")
    good = shaped & cell("item").rlike(NUMBER) & (cell("description") != "") & cell("quantity").rlike(AMOUNT) & measure_kind(cell("unit")).isNotNull()
    rows = rows.withColumns({"shaped": F.coalesce(shaped, F.lit(False)), "good": F.coalesce(good, F.lit(False)), "h_no": F.col("h.no")})
    broken = F.sum((~F.col("good") & ~F.col("head")).cast("int")).over(Window.partitionBy(*keys, "h_no").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    open_ = F.col("h_no").isNotNull() & (F.coalesce(broken, F.lit(0)) == 0)
    rows = rows.withColumns({"row": F.col("good") & open_, "spoilt": F.col("shaped") & ~F.col("good") & open_})
    # labelled items: the text behind the label, or the next line
    after, place = F.lead("raw").over(page), F.lead("at").over(page)
    own = at + lead_of(raw) + F.length("mark")
    body = F.when(F.col("opens"), F.regexp_replace(after, r"^\s+", "")).when(~F.col("empty"), F.substring(raw, lead_of(raw) + F.length("mark") + 1, F.length(raw)))
    rows = rows.withColumns({"body": body, "body_at": F.when(F.col("opens"), place + lead_of(after)).otherwise(own)})
    starts = F.col("numbered") & ~F.col("taken") & ~F.col("row") & ~F.col("spoilt") & domain_of(F.regexp_replace("body", r"^\s+", "")).isNotNull()
    rows = rows.withColumn("starts", F.coalesce(starts, F.lit(False)))
    label = F.col("line").rlike(LABEL)
    goes_on = (label | (raw.rlike(r"^[ \t]") & (F.col("line") != "") & ~F.col("numbered"))) & ~F.col("head") & ~F.col("row")
    rows = rows.withColumn("goes_on", goes_on).withColumn("s", F.last(F.when(F.col("starts"), F.struct("no", F.col("opens").cast("int").alias("skip"))), ignorenulls=True).over(upto)).withColumn("s_no", F.col("s.no"))
    beyond = F.col("no") > F.col("s.no") + F.col("s.skip")
    stops = F.sum((beyond & ~F.col("goes_on")).cast("int")).over(Window.partitionBy(*keys, "s_no").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("continues", F.coalesce(beyond & (stops == 0), F.lit(False)))

    zipped = lambda names, cells, prefix: F.zip_with(names, cells, lambda r, c: _spec(F.concat(F.lit(prefix), r), c["text"], c["start"], c["end"]))
    value = F.regexp_extract("line", LABEL, 2)
    in_line = lambda x: F.regexp_extract(x, LABEL, 2)
    parts = cells_of(F.col("body"), F.col("body_at"), F.lit("|"))
    first = F.array(_spec(F.lit("description"), parts[0]["text"], parts[0]["start"], parts[0]["end"]))
    fields = F.transform(F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda c: c["text"].rlike(LABEL)), lambda c: _spec(role_of(F.regexp_extract(c["text"], LABEL, 1)), in_line(c["text"]), c["end"] - F.length(in_line(c["text"])), c["end"]))
    marked = F.array(_spec(F.lit("item"), F.col("mark"), at + lead_of(raw), own))
    tail = F.length(raw) - F.length(F.regexp_replace(raw, r"\s+$", ""))
    end = at + F.length(raw)
    labelled = _spec(role_of(F.regexp_extract("line", LABEL, 1)), F.concat(value, F.substring(raw, F.length(raw) - tail + 1, tail)), end - tail - F.length(value), end)
    further = F.when(label, labelled).otherwise(_spec(F.lit("description"), F.regexp_replace(raw, r"^\s+", ""), at + lead_of(raw), end))
    specs = F.when(F.col("row"), F.concat(zipped(F.col("h.roles"), F.col("cells"), ""), zipped(F.col("h.roles"), F.col("h.cells"), "header_"))).when(F.col("starts"), F.concat(marked, first, fields)).when(F.col("continues"), F.array(further))
    block = F.when(F.col("row") | F.col("starts"), F.col("no")).when(F.col("continues"), F.col("s.no"))
    named = F.when(F.col("row"), cell("item")).when(F.col("starts"), F.regexp_extract("line", ITEM, 1))
    said = F.when(F.col("row"), cell("description")).when(F.col("starts"), parts[0]["text"])
    rows = rows.select(*keys, block.alias("block"), named.alias("item"), domain_of(said).alias("domain"), specs.alias("specs")).where("block IS NOT NULL")

    whole = rows.groupBy(*keys, "block").agg(F.max("item").alias("item"), F.coalesce(F.max("domain"), F.lit("OTHER")).alias("domain"), F.sort_array(F.flatten(F.collect_list("specs"))).alias("specs"))
    doubtful = F.exists("specs", lambda s: s["text"].rlike(r"[?¿]") | s["text"].rlike(CONTENTS))
    whole = whole.where(~doubtful).withColumn("specs", F.filter("specs", lambda s: s["text"] != ""))
    kinds = F.array_sort(F.array_distinct(F.transform("specs", lambda s: s["role"])))
    of = lambda role: F.filter("specs", lambda s: s["role"] == role)
    plain = F.filter(kinds, lambda r: ~r.startswith("header_") & (r != "item"))
    several = F.exists(plain, lambda r: (r != "description") & (F.size(of(r)) != 1))
    told = F.map_from_entries(F.transform(plain, lambda r: F.struct(r.alias("role"), F.array_join(F.transform(of(r), lambda s: s["text"]), " ").alias("value"))))
    places = F.map_from_entries(F.transform(kinds, lambda r: F.struct(r.alias("role"), F.transform(of(r), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("places"))))
    occurrence = F.row_number().over(Window.partitionBy(*keys).orderBy("block")) - 1
    return whole.select(*keys, occurrence.alias("occurrence"), "item", "domain", F.when(several, "AMBIGUOUS").otherwise("SUPPORTED").alias("state"), told.alias("fields"), places.alias("places"))
