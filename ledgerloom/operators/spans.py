"""Blocks and spans of pages, with the places they take in the raw text.

Which lines belong together is a fold over a page's lines (close at a blank line, at a
bullet, at a heading of a list, at a second obligation). Whether a line closes a block
depends on what stands between it and the last sure beginning only, so the fold is a
handful of windows over one partitioning by page: counts of blanks, of sure beginnings
and of obligations before a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import requirements as R
from ledgerloom.functions import tender as T
from ledgerloom.functions.text import any_pattern

#: Bullets, letters that stand alone, letters; how many make a garbled line; the shortest block or sentence.
BULLET = r"^(?:[-•*✓]|\d+[.)]|[A-Za-z][.)]|[IVXLCDM]+\.)\s*"
LONE, LETTERS = "^[a-zA-ZáéíóúÁÉÍÓÚ]$", "[A-Za-zÁÉÍÓÚáéíóúÑñ]"
TINY, MANY_LONE, FEW_LETTERS, SHORT_SIGNS, SHORTEST = 3, 4, 18, 12, 20
#: A sentence ends with a full stop or a semicolon before white space.
PIECE = r"(?s).+?[.;]\s+|.+"


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def garbled(line: Column) -> Column:
    """Whether a cleaned line holds next to nothing: up to three characters, many letters that stand alone, or few signs and no letter."""
    lone = F.size(F.filter(F.split(line, r"[^\p{L}\p{N}_]+"), lambda x: x.rlike(LONE)))
    more = line.rlike(f"(?:{LETTERS}[^{LETTERS[1:]}*+){{{FEW_LETTERS + 1}}}")
    return (F.length(line) <= TINY) | (~more & (lone >= MANY_LONE)) | ((F.length(line) < SHORT_SIGNS) & ~line.rlike(LETTERS))


def page_lines(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, __no, __at, __raw): lines, numbered and placed from 0 in code points; CR and LF end one each."""
    rows = pages.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, r"[\r\n]")).alias("__no", "__raw"))
    before = Window.partitionBy(*keys).orderBy("__no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__at", F.coalesce(F.sum(F.length("__raw") + 1).over(before), F.lit(0)))


def block_lines(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """page_lines that belong to a block, with `__block`, numbered from 1 within the page.

    Blank lines, bullets and headings that announce a list (and end with a colon) begin
    a block; so does a line that obliges if one in the block does already. Whatever
    follows a heading joins it; a heading that nothing follows is left out, and so are
    garbled lines, which part nothing.
    """
    here = Window.partitionBy(*keys).orderBy("__no")
    c, t = clean(F.col("__raw")), T.plain(F.col("__raw"))
    rows = page_lines(pages, keys, text).withColumns({"__blank": c == "", "__gap": F.sum((c == "").cast("int")).over(here)})
    rows = rows.where(~F.col("__blank") & ~garbled(c))
    anchor = t.rlike(any_pattern((*R.OBLIGING, R.IMPERATIVE_LATER)))
    rows = rows.withColumns({"__head": t.rlike(R.CHECKLIST) & c.endswith(":"), "__bullet": c.rlike(BULLET), "__anchor": anchor})
    joined = ~F.col("__head") & F.coalesce(F.lag("__head").over(here) & (F.lag("__gap").over(here) == F.col("__gap")), F.lit(False))
    rows = rows.withColumn("__joined", joined)
    sure = F.col("__head") | (~F.col("__joined") & (F.col("__bullet") | F.coalesce(F.lag("__gap").over(here) < F.col("__gap"), F.lit(True))))
    rows = rows.withColumn("__sure", sure).withColumn("__part", F.sum(F.col("__sure").cast("int")).over(here))
    before = Window.partitionBy(*keys, "__part").orderBy("__no").rowsBetween(Window.unboundedPreceding, -1)
    again = ~F.col("__sure") & ~F.col("__joined") & F.col("__anchor") & (F.coalesce(F.sum(F.col("__anchor").cast("int")).over(before), F.lit(0)) > 0)
    rows = rows.withColumn("__begins", F.col("__sure") | again).withColumn("__followed", F.coalesce(F.lead("__joined").over(here), F.lit(False)))
    rows = rows.withColumn("__block", F.sum(F.col("__begins").cast("int")).over(here)).where(~F.col("__head") | F.col("__followed"))
    return rows.select(*keys, "__no", "__at", "__raw", "__block")


def spans(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, block, span, text, places) of pages: sentences of a block of 20 characters or more, or the whole block if less than two are so long.

    text is the span with single spaces; places are the [start, end) of its pieces in
    the raw text, whose cleaned pieces joined by spaces give the span again. Null and
    empty texts have none. Keys must tell pages apart; rows that repeat a key are one page.
    """
    pieces = F.transform(F.regexp_extract_all("__raw", F.lit(PIECE), 0), lambda x: F.struct(x.alias("raw"), clean(x).alias("text")))
    rows = block_lines(pages, keys, text).select(*keys, "__no", "__at", "__block", F.posexplode(pieces).alias("__k", "__p"))
    line = Window.partitionBy(*keys, "__no").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.length("__p.raw") - F.length(F.regexp_replace("__p.raw", r"^\s+", ""))
    start = F.col("__at") + F.coalesce(F.sum(F.length("__p.raw")).over(line), F.lit(0)) + lead
    end = start + F.length(F.regexp_replace(F.col("__p.raw"), r"^\s+|\s+$", ""))
    rows = rows.select(*keys, "__no", "__k", "__block", F.col("__p.text").alias("__text"), start.alias("__start"), end.alias("__end"))
    order = Window.partitionBy(*keys, "__block").orderBy("__no", "__k")
    rows = rows.withColumn("__first", F.coalesce(F.lag("__text").over(order).rlike("[.;]$"), F.lit(True)))
    rows = rows.withColumn("__sentence", F.sum(F.col("__first").cast("int")).over(order))
    sentence, block = Window.partitionBy(*keys, "__block", "__sentence"), Window.partitionBy(*keys, "__block")
    size = lambda w: F.sum(F.length("__text") + 1).over(w) - 1
    rows = rows.withColumns({"__size": size(sentence), "__whole": size(block)})
    rows = rows.withColumn("__useful", F.sum((F.col("__first") & (F.col("__size") >= SHORTEST)).cast("int")).over(block))
    rows = rows.where((F.col("__whole") >= SHORTEST) & ((F.col("__useful") <= 1) | (F.col("__size") >= SHORTEST)))
    span = F.when(F.col("__useful") <= 1, 0).otherwise(F.col("__sentence"))
    parts = F.sort_array(F.collect_list(F.struct("__start", "__end", "__text")))
    out = rows.groupBy(*keys, F.col("__block").alias("block"), span.alias("span")).agg(parts.alias("__parts"))
    places = F.transform("__parts", lambda x: F.struct(x["__start"].alias("start"), x["__end"].alias("end")))
    return out.select(*keys, "block", "span", F.array_join(F.col("__parts")["__text"], " ").alias("text"), places.alias("places"))
