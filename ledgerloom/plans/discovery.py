"""Effects and candidates out of pages: one for each part, of a sentence for each of its order lines; parts are documents of a tender."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import requirements as R
from ledgerloom.functions import tender as T
from ledgerloom.operators import discovery as D
from ledgerloom.plans.base import query, table

LINES = (
    "Se modifica el numeral {q}.2 del Anexo {q}; el resto queda igual.", "Se sustituye en su totalidad el Anexo Técnico por el Formato B-{q}.", "Queda sin efecto la Convocatoria.", "El plazo vence el {q}/05/2024 o el 2024-06-{q} según el apartado IV.",
    "Se aclara: la página {q}, tabla 3 de las Bases de Licitación. Se corrigen fechas.", "Se adiciona el inciso b) al requisito {q}.1; véase Documento X{q}.", "Los trabajos inician en la planta norte a las {q}.30 horas! ¿Qué más? Nada", "Se revoca el párrafo {q} por la Convocatoria", "   ",
    "SE REEMPLAZA la cláusula {q} del documento completo Anexo {q}-A por el Anexo {q}-A.", "anexo {q} y Anexo {q}: partida {q}, Partida {q}",
)
FILES = ("Anexo {s}.pdf", "Bases de Licitacion.pdf", "Convocatoria final.docx", "Documento X{s}.pdf", "Formato B-{s}.xlsx", "anexo_tecnico.rev.pdf", "Anexo Tecnico.pdf", "otro {s}")


def part_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(group, document, page, text)"""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    line = F.replace(F.element_at(F.lit(list(LINES)), (k % len(LINES) + 1).cast("int")), F.lit("{q}"), F.col("l_quantity").cast("int").cast("string"))
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("document"), F.col("l_suppkey").alias("page"), F.struct(k.alias("k"), line.alias("line")).alias("l"))
    text = F.array_join(F.sort_array(F.collect_list("l"))["line"], "\n")
    return rows.groupBy("document", "page").agg(text.alias("text")).select(F.floor(F.col("document") / 40).alias("group"), "document", "page", "text")


def tender_documents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.replace(F.element_at(F.lit(list(FILES)), (k % len(FILES) + 1).cast("int")), F.lit("{s}"), F.col("p_size").cast("string"))
    path = F.when(k % 3 == 0, F.concat(F.lit("tender/"), F.col("p_brand"), F.lit("/"), name))
    return table(spark, sf, "part").select(F.floor(k / 40).alias("group"), k.alias("document"), name.alias("filename"), path.alias("path"))


def listed(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


PAGES_SQL = f"""pages AS (SELECT l_partkey // 40 AS grp, l_partkey AS document, l_suppkey AS page, string_agg(line, chr(10) ORDER BY k, line) AS text FROM (SELECT *, l_orderkey + l_linenumber AS k, replace({listed(LINES)}[(l_orderkey + l_linenumber) % {len(LINES)} + 1], '{{q}}', CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS line FROM lineitem) GROUP BY 1, 2, 3)"""


def normal(x: str) -> str:
    return rf"upper(trim(regexp_replace({x}, '\s+', ' ', 'g')))"


def first_sql(x: str, patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({x}, '(?i){p}')), '')" for p in patterns) + ")"


def stem_sql(x: str) -> str:
    return rf"regexp_replace(regexp_extract({x}, '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1')"


EFFECTS_SQL = rf"""{PAGES_SQL},
s AS (SELECT grp, document, page, unnest(x) AS said, unnest(range(len(x))) AS pos FROM (SELECT *, list_filter(list_transform(flatten(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda y: regexp_extract_all(trim(y), '(?s).+?[.;:]\s+|.+'))), lambda y: trim(regexp_replace(y, '\s+', ' ', 'g'))), lambda y: y <> '') AS x FROM pages)),
k AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(said, '(?i){p}') THEN '{n}'" for n, p in D.ANCHORS)} END AS kind, {first_sql("said", D.REFERENCES)} AS reference, {first_sql("said", D.LOCATORS)} AS locator, strpos(lower(said), ' por ') AS cut FROM s),
n AS (SELECT *, reference IS NOT NULL OR locator IS NOT NULL AS named, {normal("reference")} AS alias, CASE WHEN cut > 0 THEN {first_sql("substr(said, cut + 5)", D.REFERENCES)} END AS other FROM k WHERE kind IS NOT NULL),
d AS (SELECT p_partkey // 40 AS grp, p_partkey AS document, replace({listed(FILES)}[p_partkey % {len(FILES)} + 1], '{{s}}', CAST(p_size AS VARCHAR)) AS filename, p_brand FROM part),
a0 AS (SELECT grp, document, list_filter([{normal("filename")}, {normal(stem_sql("filename"))}, CASE WHEN document % 3 = 0 THEN {normal("'tender/' || p_brand || '/' || filename")} END, CASE WHEN document % 3 = 0 THEN {normal(stem_sql("'tender/' || p_brand || '/' || filename"))} END], lambda x: x IS NOT NULL AND x <> '') AS names FROM d),
a1 AS (SELECT grp, document, list_concat(names, [CASE WHEN len(list_filter(names, lambda x: contains(x, 'BASES DE LICITACION'))) > 0 THEN 'BASES' END, CASE WHEN len(list_filter(names, lambda x: contains(x, 'CONVOCATORIA'))) > 0 THEN 'CONVOCATORIA' END],
 list_transform(names, lambda x: CASE WHEN contains(x, 'ANEXO TECNICO') THEN 'ANEXO TECNICO' WHEN regexp_extract(x, '\bANEXO[\s\-_\.]*([A-Z0-9]+)\b', 1) <> '' THEN 'ANEXO ' || regexp_extract(x, '\bANEXO[\s\-_\.]*([A-Z0-9]+)\b', 1) END)) AS names FROM a0),
i AS (SELECT grp, alias, count(DISTINCT document) AS n, min(document) AS one FROM (SELECT grp, document, unnest(names) AS alias FROM a1) WHERE alias IS NOT NULL GROUP BY 1, 2),
m AS (SELECT k.*, i.n, i.one, CASE WHEN named THEN row_number() OVER (PARTITION BY k.grp, document, page, named ORDER BY pos) - 1 END AS idx, CASE WHEN NOT named THEN NULL WHEN locator IS NOT NULL THEN 'PARTIAL' WHEN regexp_matches(said, '(?i){D.WIDE}') THEN 'DOCUMENT_WIDE' ELSE 'UNRESOLVED' END AS scope, coalesce(named AND {normal("other")} <> k.alias, FALSE) AS third FROM n k LEFT JOIN i ON i.grp = k.grp AND i.alias = k.alias),
e AS (SELECT *, CASE WHEN NOT named THEN 'MISSING_TARGET_CONTEXT' WHEN alias IS NULL THEN NULL WHEN n IS NULL THEN 'UNRESOLVED_TARGET_DOCUMENT' WHEN n > 1 THEN 'AMBIGUOUS_TARGET_DOCUMENT' WHEN one = document THEN 'SAME_DOCUMENT_TARGET' END AS diagnostic FROM m)"""


@query(f"""WITH {EFFECTS_SQL} SELECT document, page, pos AS place, idx AS index, kind, scope, reference, locator, CASE WHEN alias IS NOT NULL AND diagnostic IS NULL THEN one END AS target, diagnostic, third, diagnostic IS NOT NULL OR third OR coalesce(scope = 'UNRESOLVED', FALSE) AS review FROM e""")
def effects_from_text(spark: SparkSession, sf: str) -> DataFrame:
    """Effects that pages state: on what document, of what scope, at what place."""
    found = D.effects_in_texts(part_pages(spark, sf), "page", "text", tender_documents(spark, sf))
    return found.select("document", "page", F.col("at").alias("place"), "index", "kind", "scope", "reference", "locator", "target", "diagnostic", "third", F.coalesce("review", F.lit(False)).alias("review"))


LITERAL_SQL = r"""string_split_regex(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\d)\.(\d)', '\1' || chr(2) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(2) || '\2', 'g'), '(\d)!(\d)', '\1' || chr(3) || '\2', 'g'), '(\d)!(\d)', '\1' || chr(3) || '\2', 'g'), '(\d)\?(\d)', '\1' || chr(4) || '\2', 'g'), '(\d)\?(\d)', '\1' || chr(4) || '\2', 'g'), '', ''), '([.!?])', '\1' || chr(1), 'g'), chr(1))"""
SPANS_SQL = rf"""w AS (SELECT *, {LITERAL_SQL} AS x FROM texts), v AS (SELECT id, unnest(list_transform(x, lambda y: translate(y, chr(2) || chr(3) || chr(4), '.!?'))) AS span, unnest(range(len(x))) AS k FROM w),
u AS (SELECT *, coalesce(sum(length(span)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM v),
o AS (SELECT id, span, s, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN regexp_matches(span, '(?i){D.DRAWING}') THEN 0 ELSE 1 END, k) AS rank FROM u WHERE trim(regexp_replace(span, '\s+', ' ', 'g')) <> '' QUALIFY rank <= {D.MOST_SPANS})"""


@query(f"WITH texts AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), {SPANS_SQL} SELECT id AS doc_id, rank, CAST(s AS BIGINT) AS start, CAST(s + length(span) AS BIGINT) AS stop, span FROM o")
def evidence_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of whole texts that are offered as evidence, with their places."""
    found = D.offered_spans(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text")
    return found.select("doc_id", "rank", "start", F.col("end").alias("stop"), "span")


#: DuckDB's word ends know ASCII only: an annex must end before what is no letter or digit at all.
ANNEX_SQL = "(" + D.TARGETS[0].removesuffix(r"\b") + r")(?:[^\pL\pN_]|$)"
CANDIDATES_SQL = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT id, rank, span, s, '{kind}' AS kind, {k} AS pattern, unnest(x) AS raw, unnest(range(len(x))) AS place FROM (SELECT *, regexp_extract_all(span, '(?i){ANNEX_SQL if p == D.TARGETS[0] else p}', {int(p == D.TARGETS[0])}) AS x FROM o)" for kind, patterns in (("TARGET", D.TARGETS), ("LOCATOR", D.LOCATORS), ("DATE", D.DATES)) for k, p in enumerate(patterns)
) + ")"


@query(f"""WITH {PAGES_SQL}, texts AS (SELECT document || '/' || page AS id, text FROM pages), {SPANS_SQL}, c AS ({CANDIDATES_SQL}),
f AS (SELECT id, rank, span, s, kind, min({{'pattern': pattern, 'place': place, 'raw': raw}}) AS c FROM (SELECT *, CASE WHEN kind = 'DATE' THEN raw ELSE {normal("raw")} END AS same FROM c) GROUP BY id, rank, span, s, kind, same)
SELECT id, kind, row_number() OVER (PARTITION BY id, kind ORDER BY rank, c.pattern, c.place) AS number, rank, c.raw AS raw, CAST(s + strpos(span, c.raw) - 1 AS BIGINT) AS start FROM f""")
def evidence_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Targets, places and dates that offered sentences name, with where they stand."""
    pages = part_pages(spark, sf).select(F.concat_ws("/", "document", "page").alias("id"), "text")
    return D.candidates(D.offered_spans(pages, ["id"], "text"), ["id"]).select("id", "kind", "number", "rank", "raw", "start")


PLAIN_SQL = r"trim(regexp_replace(translate(lower(text), 'áéíóúüñ', 'aeiouun'), '\s+', ' ', 'g'))"


@query(f"""WITH {PAGES_SQL}, t AS (SELECT document, page, {PLAIN_SQL} AS t FROM pages)
SELECT document, page, coalesce({", ".join(f"nullif(regexp_extract(t, '{p}'), '')" for p in T.PLACES)}) AS place, CASE WHEN regexp_matches(t, '{T.ANNEX_PLAIN}') THEN 'ANEXO:' || upper(regexp_replace(replace(regexp_extract(t, '{T.ANNEX_PLAIN}', 1), '.', '-'), '[^a-z0-9-]', '', 'g')) {" ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in T.REFERENCE_WORDING)} END AS target FROM t""")
def change_places(spark: SparkSession, sf: str) -> DataFrame:
    """The place and the document that each page speaks of first."""
    t = T.plain(F.col("text"))
    return part_pages(spark, sf).select("document", "page", T.place(t).alias("place"), T.target(t).alias("target"))


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c, {PLAIN_SQL} AS t FROM documents)
SELECT doc_id, CAST(regexp_matches(t, '{R.PLACEHOLDER}') AS INT) AS placeholder, len(regexp_extract_all(c, '{R.BAD_SIGNS}')) AS signs, len(list_filter(string_split_regex(left(c, 80), '[^\pL\pN_]+'), lambda x: regexp_matches(x, '{R.LONE}'))) AS lone, -len(regexp_extract_all(c, '{R.LETTERS}')) AS letters FROM t""")
def text_qualities(spark: SparkSession, sf: str) -> DataFrame:
    """How well each text reads."""
    return table(spark, sf, "documents").select("doc_id", R.text_quality(F.col("text"), T.plain(F.col("text"))).alias("q")).select("doc_id", "q.*")
