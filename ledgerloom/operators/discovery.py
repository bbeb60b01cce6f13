"""What texts say of other documents: effects with kind, target, scope and place; and literal candidates for each, with their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.durable import roomy

#: Wording of each effect, in order; the first that a sentence holds tells its kind.
ANCHORS = (
    ("SUPERSEDES", r"\bse\s+(?:sustituye|reemplaza)\b"), ("AMENDS", r"\bse\s+modific(?:a|an)\b"), ("CORRECTS", r"\bse\s+corrig(?:e|en)\b"), ("CLARIFIES", r"\bse\s+aclar(?:a|an)\b"),
    ("SUPPLEMENTS", r"\bse\s+(?:complementa|adiciona)\b"), ("REVOKES", r"\b(?:queda|quedan)\s+sin\s+efecto\b|\bse\s+deja(?:n)?\s+sin\s+efecto\b|\bse\s+revoc(?:a|an)\b"),
)
#: How documents are referred to, and places in them; in order.
REFERENCES = (
    r"\bAnexo\s+(?:T[eé]cnico(?:\s+Rev\.?\s*\d+)?|[A-Z0-9]+(?:[-\.][A-Z0-9]+)*)\b", r"\bBases(?:\s+de\s+Licitaci[oó]n)?\b", r"\bConvocatoria\b", r"\bDocumento\s+[A-Z0-9]+(?:[-\.][A-Z0-9]+)*\b",
    r"\bFormato\s+[A-Z0-9]+(?:[-\.][A-Z0-9]+)*\b",
)
LOCATORS = (
    r"\bnumeral\s+\d+(?:\.\d+)*[a-z]?\b", r"\bapartado\s+[a-z0-9][a-z0-9\.\-]*\b", r"\bsecci[oó]n\s+[ivxlcdm0-9]+(?:\.\d+)*\b", r"\bcl[aá]usula\s+\d+(?:\.\d+)*\b", r"\binciso\s+[a-z]\)?\b",
    r"\bp[aá]gina\s+\d+\b", r"\btabla\s+\d+\b", r"\bpartida\s+\d+\b", r"\brequisito\s+\d+(?:\.\d+)*\b", r"\bp[aá]rrafo\s+\d+\b",
)
WIDE = r"\ben\s+su\s+totalidad\b|\bdocumento\s+completo\b|\bla\s+totalidad\s+del\b|\bla\s+totalidad\s+de\s+la\b"
#: Words that draw a sentence to the front, and what may be a target or a date; at most so many sentences of a text are offered.
DRAWING = (
    r"\b(?:se\s+)?(?:modific(?:a|an|ó|arse)|modified|revis(?:a|an|ó)|sustituy(?:e|en|ó)|reemplaz(?:a|an|ó)|corrig(?:e|en|ió)|aclar(?:a|an|ó)|adicion(?:a|an|ó)|complement(?:a|an|ó)|revoc(?:a|an|ó)"
    r"|qued(?:a|an)\s+sin\s+efecto|deja(?:n)?\s+sin\s+efecto|modificaci[oó]n|amend(?:ed|s)|supersed(?:es|ed)|clarif(?:y|ies|ied)|correct(?:ed|s)|supplement(?:s|ed)|revok(?:e|es)|amend)\b"
)
TARGETS = (
    r"\bAnexo\s+[A-Za-z0-9]+(?:[-\.]?[A-Za-z0-9]+)*\b", r"\bBases(?:\s+de\s+Licitaci[oó]n)?\b", r"\bConvocatoria\b",
    r"\b(?:Secci[oó]n|Apartado|Numeral|Cl[aá]usula|Inciso|P[aá]rrafo)\s+[A-Za-z0-9IVXLCDM\.\-]+\b",
)
DATES = (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b")
MOST_SPANS = 5
#: Characters of the texts of one task; each of their sentences is sorted as a row of its own, some times over.
CHARS = 4_000_000

ANY_CASE = "(?iu)"
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normal(x: Column) -> Column:
    """Single spaces, upper case."""
    return F.upper(clean(x))


def first_of(x: Column, patterns: tuple[str, ...]) -> Column:
    """The first match of the first pattern that has one, trimmed; else null."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(x, ANY_CASE + p, 0)), F.lit("")) for p in patterns])


def sentences(text: Column) -> Column:
    """Sentences of lines, with single spaces: parted behind full stops, semicolons and colons; those left empty are not kept."""
    parts = F.flatten(F.transform(F.split(text, LINE_ENDS), lambda x: F.regexp_extract_all(F.trim(x), F.lit(r"(?s).+?[.;:]\s+|.+"), 0)))
    return F.filter(F.transform(parts, clean), lambda x: x != "")


def stem(path: Column) -> Column:
    """The last part of a path without its ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def aliases(filename: Column, path: Column) -> Column:
    """Names under which a document is referred to: its file name and path, with and without ending, and BASES, CONVOCATORIA or its annex if these name one."""
    names = F.array_distinct(F.filter(F.array(normal(filename), normal(stem(filename)), normal(path), normal(stem(path))), lambda x: x.isNotNull() & (x != "")))
    has = lambda words: F.exists(names, lambda x: F.contains(x, F.lit(words)))
    general = F.array_compact(F.array(F.when(has("BASES DE LICITACION"), "BASES"), F.when(has("CONVOCATORIA"), "CONVOCATORIA")))
    mark = lambda x: F.regexp_extract(x, r"\bANEXO[\s\-_\.]*([A-Z0-9]+)\b", 1)
    annexes = F.transform(names, lambda x: F.when(F.contains(x, F.lit("ANEXO TECNICO")), "ANEXO TECNICO").when(mark(x) != "", F.concat(F.lit("ANEXO "), mark(x))))
    return F.array_distinct(F.concat(names, general, F.array_compact(annexes)))


def effects_in_texts(pages: DataFrame, page: str, text: str, documents: DataFrame) -> DataFrame:
    """(group, document, page, at, index, kind, scope, reference, locator, target, diagnostic, third, review) of each sentence of `pages` that states an effect.

    pages: (group, document, page, text); documents: (group, document, filename, path).
    A sentence that names neither a document nor a place has MISSING_TARGET_CONTEXT and
    no index; others are numbered from 0 within their page. References are looked up
    among the names of the group's documents: none, several, or the acting document
    itself leave the target open and ask for a review, as do an open scope and another
    reference behind " por ". Copies of a document under other ids make its name ambiguous.
    """
    rows = pages.select("group", "document", page, F.posexplode(sentences(F.col(text))).alias("at", "said"))
    kind = F.coalesce(*[F.when(F.col("said").rlike(ANY_CASE + p), F.lit(k)) for k, p in ANCHORS])
    # one look for any wording; which it is, is asked of the few sentences that hold one
    rows = rows.where(F.col("said").rlike(ANY_CASE + "|".join(f"(?:{p})" for _, p in ANCHORS))).withColumn("kind", kind).withColumns({"reference": first_of(F.col("said"), REFERENCES), "locator": first_of(F.col("said"), LOCATORS)})
    cut = F.locate(" por ", F.lower("said"))
    third = F.when(cut > 0, first_of(F.substring(F.col("said"), cut + 5, F.length("said")), REFERENCES))
    named = F.col("reference").isNotNull() | F.col("locator").isNotNull()
    in_page = Window.partitionBy("group", "document", page, named).orderBy("at")
    scope = F.when(F.col("locator").isNotNull(), "PARTIAL").when(F.col("said").rlike(ANY_CASE + WIDE), "DOCUMENT_WIDE").otherwise("UNRESOLVED")
    rows = rows.withColumns({"named": named, "index": F.when(named, F.row_number().over(in_page) - 1), "scope": F.when(named, scope), "alias": normal(F.col("reference"))})
    rows = rows.withColumn("third", F.coalesce(named & (normal(third) != F.col("alias")), F.lit(False)))
    known = documents.select("group", F.col("document").alias("__d"), F.explode(aliases(F.col("filename"), F.col("path"))).alias("alias"))
    index = known.groupBy("group", "alias").agg(F.count_distinct("__d").alias("__n"), F.min("__d").alias("__one"))
    rows = rows.join(index, ["group", "alias"], "left")
    diagnostic = (
        F.when(~F.col("named"), "MISSING_TARGET_CONTEXT").when(F.col("alias").isNull(), None).when(F.col("__n").isNull(), "UNRESOLVED_TARGET_DOCUMENT")
        .when(F.col("__n") > 1, "AMBIGUOUS_TARGET_DOCUMENT").when(F.col("__one") == F.col("document"), "SAME_DOCUMENT_TARGET")
    )
    rows = rows.withColumn("diagnostic", diagnostic)
    target = F.when(F.col("alias").isNotNull() & F.col("diagnostic").isNull(), F.col("__one"))
    return rows.select(
        "group", "document", page, "at", "index", "kind", "scope", "reference", "locator", target.alias("target"), "diagnostic", "third",
        (F.col("diagnostic").isNotNull() | F.col("third") | (F.col("scope") == "UNRESOLVED")).alias("review"),
    )


#: Sentences as written: they end with . ! or ?, unless these stand between digits.
LITERAL = r"(?s)(?:[^.!?]|(?<=\d)[.!?](?=\d))*+[.!?]|(?s)(?:[^.!?]|(?<=\d)[.!?](?=\d))++$"


def offered_spans(pages: DataFrame, keys: list[str], text: str, most: int = MOST_SPANS) -> DataFrame:
    """(keys, rank, span, start, end): sentences of a text as written, those that speak of a change first, `most` of them a text; text[start:end] is the span."""
    pages = roomy(pages.where(F.col(text).isNotNull()).select(*keys, text), keys, F.length(text), CHARS)
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(LITERAL), 0)).alias("__k", "span"))
    before = Window.partitionBy(*keys).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("span")).over(before), F.lit(0))).where(F.trim(F.regexp_replace("span", r"\s+", " ")) != "")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy((~F.col("span").rlike(ANY_CASE + DRAWING)).cast("int"), "__k"))
    return rows.select(*keys, rank.alias("rank"), "span", "start", (F.col("start") + F.length("span")).alias("end")).where(F.col("rank") <= most)


def candidates(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, number, rank, raw, start, end) of what offered spans (keys, rank, span, start) name: TARGETs, LOCATORs and DATEs.

    Each once a span, by its wording with single spaces in upper case (dates as they
    are); numbered within a text by span, pattern and place. text[start:end] is raw.
    """
    def matches(kind: str, k: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("span", F.lit(ANY_CASE + pattern), 0), lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("pattern"), i.alias("place"), x.alias("raw")))

    found = [matches(kind, k, p) for kind, patterns in (("TARGET", TARGETS), ("LOCATOR", LOCATORS), ("DATE", DATES)) for k, p in enumerate(patterns)]
    rows = spans.select(*keys, "rank", "span", F.col("start").alias("__from"), F.explode(F.concat(*found)).alias("c"))
    same = F.when(F.col("c.kind") == "DATE", F.col("c.raw")).otherwise(normal(F.col("c.raw")))
    rows = rows.groupBy(*keys, "rank", "span", "__from", F.col("c.kind").alias("kind"), same.alias("same")).agg(F.min(F.struct("c.pattern", "c.place", "c.raw")).alias("c"))
    number = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("rank", "c.pattern", "c.place"))
    start = F.col("__from") + F.call_function("instr", F.col("span"), F.col("c.raw")) - 1
    return rows.select(*keys, "kind", number.alias("number"), "rank", F.col("c.raw").alias("raw"), start.alias("start"), (start + F.length("c.raw")).alias("end"))


def selected(choices: DataFrame, spans: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """choices (keys, choice, rank, target, locator, locator_raw, date, date_raw) with `error`, and what they come to: locator_raw, date_raw, excerpt.

    A choice's span must be offered, its target, locator and date must be candidates of
    that span, wording given beside a number must be that candidate's, and wording
    given alone must stand in the span as it is. The first rule broken is the error.
    """
    out = choices.join(spans.select(*keys, "rank", "span"), [*keys, "rank"], "left")
    for kind in ("target", "locator", "date"):
        some = offered.where(F.col("kind") == kind.upper()).select(*keys, F.col("number").alias(kind), F.col("rank").alias(f"__{kind}_rank"), F.col("raw").alias(f"__{kind}"))
        out = out.join(some, [*keys, kind], "left")

    def broken(kind: str, wording: Column | None) -> list[Column]:
        chosen, rank, raw = F.col(kind).isNotNull(), F.col(f"__{kind}_rank"), F.col(f"__{kind}")
        codes = [F.when(chosen & rank.isNull(), f"UNKNOWN_{kind.upper()}"), F.when(chosen & (rank != F.col("rank")), f"{kind.upper()}_OF_ANOTHER_SPAN")]
        if wording is not None:
            codes += [F.when(chosen & (wording != raw), f"{kind.upper()}_WORDING_DIFFERS"), F.when(~chosen & wording.isNotNull() & ~F.contains("span", wording), f"{kind.upper()}_NOT_GROUNDED")]
        return codes

    error = F.coalesce(F.when(F.col("span").isNull(), "UNKNOWN_SPAN"), *broken("target", None), *broken("locator", F.col("locator_raw")), *broken("date", F.col("date_raw")))
    out = out.withColumn("error", error)
    fine = F.col("error").isNull()
    return out.select(*keys, "choice", "error", F.when(fine, F.coalesce("__locator", "locator_raw")).alias("locator_raw"), F.when(fine, F.coalesce("__date", "date_raw")).alias("date_raw"), F.when(fine, F.col("span")).alias("excerpt"))


def grounded(value: Column, excerpt: Column, source: Column) -> Column:
    """NO_EXCERPT, EXCERPT_NOT_IN_SOURCE, VALUE_NOT_IN_EXCERPT or GROUNDED: the excerpt must stand in the source and the value in the excerpt, by single spaces and upper case; no value needs no place."""
    v, e, s = normal(value), normal(excerpt), normal(source)
    none = lambda x: x.isNull() | (x == "")
    return F.when(none(e), "NO_EXCERPT").when(none(s) | ~F.contains(s, e), "EXCERPT_NOT_IN_SOURCE").when(~none(v) & ~F.contains(e, v), "VALUE_NOT_IN_EXCERPT").otherwise("GROUNDED")
