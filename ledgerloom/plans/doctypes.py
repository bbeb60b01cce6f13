"""What kind of dossier documents are: three documents are the pages of one, under headings dealt to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import doctypes as D
from ledgerloom.plans.base import query, table

HEADS = (
    "CONVOCATORIA PÚBLICA", "Modelo de contrato", "Catálogo de conceptos", "Índice", "1. Bases de contratacion", "2. Formato de entrega - página 4", "Anexos", "De acuerdo con el cronograma", "Alcance de los servicios y especificaciones técnicas",
    "El licitante presentará una fianza por el diez por ciento del monto total del contrato que se le adjudique en moneda nacional", "Requisitos legales", "Experiencia", "Sin señal", "Programa de ejecución", "ver anexo: propuesta economica", "Adenda",
)
NAMES = ("01_Bases de Contratación.pdf", "2) convocatoria.docx", "Modelo de Contrato LP-2024-07.pdf", "Anexo 3.B Formato.pdf", "notas")


def any_of(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def listed(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
RULE_ROWS = ", ".join(f"('{kind}', '{term}', {n})" for kind, terms in D.SIGNALS.items() for n, term in enumerate(terms))
PAGES_SQL = f"""h AS (SELECT {listed(HEADS)} AS hs, {listed(NAMES)} AS ns), p AS (SELECT doc_id // 3 AS doc, CAST(doc_id % 3 * 3 + 1 AS INT) AS page, concat_ws(chr(10), hs[doc_id % 16 + 1], hs[doc_id * 7 % 16 + 1], ' ' || hs[doc_id * 5 % 13 + 1], text) AS t FROM documents, h),
q AS (SELECT doc, page, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\r\\n]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls, {any_of(NORM.format('t'), D.CONTENTS_CUES)} AS cued FROM p),
l AS (SELECT doc, page, cued, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS pos FROM q), n AS (SELECT *, {NORM.format('line')} AS norm FROM l),
c AS (SELECT doc, page, bool_or(cued) AND sum(CASE WHEN regexp_matches(norm, '{D.LISTING}') OR {any_of('line', D.LISTED)} THEN 1 ELSE 0 END) >= 3 AS contents FROM n GROUP BY 1, 2),
r(type, term, ord) AS (VALUES {RULE_ROWS}),
m AS (SELECT n.doc, n.page, n.pos, n.line, n.norm, r.type, min_by(r.term, r.ord) AS signal FROM n JOIN r ON contains(n.norm, r.term) GROUP BY ALL),
w AS (SELECT m.*, contents, len(string_split(norm, ' ')) AS words, len(regexp_extract_all(line, '\\p{{L}}')) > 0 AND len(regexp_extract_all(line, '\\p{{Lu}}')) >= 0.6 * len(regexp_extract_all(line, '\\p{{L}}')) AS upper, trim(string_split(norm, signal)[1]) AS front FROM m JOIN c USING (doc, page)),
k AS (SELECT doc, page, type, signal, words, CASE WHEN contents THEN 'REFERENCE_LIST' WHEN words <= 14 AND (starts_with(norm, signal) OR upper OR length(norm) <= length(signal) + 35) AND (pos <= 2 OR page <= 3 OR upper)
 AND NOT ({any_of('norm', D.REFERENCE_CUES)} OR (front <> '' AND len(string_split(front, ' ')) >= 2)) THEN 'ANCHOR' ELSE 'REFERENCE' END AS kind FROM w),
o AS (SELECT doc, page, type, signal, kind, CASE kind WHEN 'ANCHOR' THEN 35 + CASE WHEN words <= 8 THEN 10 ELSE 0 END + CASE WHEN page <= 3 THEN 10 ELSE 0 END WHEN 'REFERENCE' THEN 8 ELSE 4 END AS weight FROM k)"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    docs, k = table(spark, sf, "documents"), F.col("doc_id")
    head = lambda n: F.element_at(F.lit(list(HEADS)), (n + 1).cast("int"))
    text = F.concat_ws("\n", head(k % 16), head(k * 7 % 16), F.concat(F.lit(" "), head(k * 5 % 13)), "text")
    return docs.select(F.floor(k / 3).alias("doc"), (k % 3 * 3 + 1).cast("int").alias("page"), text.alias("t"))


@query(f"WITH {PAGES_SQL} SELECT doc, page, type, signal, kind, weight, count(*) AS n FROM o GROUP BY ALL")
def signal_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of document types in lines: anchors, references and entries of lists."""
    found = D.occurrences(pages(spark, sf), "doc", "page", "t")
    return found.groupBy("doc", "page", "type", "signal", "kind", "weight").agg(F.count("*").alias("n"))


@query(f"""WITH {PAGES_SQL}, b AS (SELECT doc, type, signal, max(struct_pack(a := CASE kind WHEN 'ANCHOR' THEN 3 WHEN 'REFERENCE' THEN 2 ELSE 1 END, w := weight)) AS b FROM o GROUP BY 1, 2, 3),
d AS (SELECT DISTINCT doc FROM p), f AS (SELECT DISTINCT doc, type FROM d, h, r WHERE contains(lower(ns[doc % 5 + 1]), term)),
s AS (SELECT doc, type, sum(score) AS score, sum(anchored) AS anchored FROM (SELECT doc, type, b.w AS score, CASE WHEN b.a = 3 THEN b.w ELSE 0 END AS anchored FROM b UNION ALL SELECT doc, type, 12, 0 FROM f) GROUP BY 1, 2),
t AS (SELECT doc, min(CASE WHEN score >= 35 AND type <> 'DOCUMENT_PACKAGE' THEN struct_pack(s := -score, t := type) END) AS top, sum(CASE WHEN type IN {D.AUTONOMOUS} AND anchored >= 35 THEN 1 ELSE 0 END) AS own, sum(CASE WHEN type IN {D.AUTONOMOUS} AND anchored >= 35 THEN anchored ELSE 0 END) AS whole FROM s GROUP BY 1)
SELECT d.doc, CASE WHEN own >= 3 THEN 'DOCUMENT_PACKAGE' ELSE coalesce(top.t, 'UNKNOWN') END AS type, CAST(CASE WHEN own >= 3 THEN whole ELSE coalesce(-top.s, 0) END AS BIGINT) AS score FROM d LEFT JOIN t USING (doc)""")
def document_types(spark: SparkSession, sf: str) -> DataFrame:
    """The type of each dossier: its signals' best occurrences, summed, and its file's name."""
    rows = pages(spark, sf)
    docs = rows.select("doc").distinct().withColumn("name", F.element_at(F.lit(list(NAMES)), (F.col("doc") % 5 + 1).cast("int")))
    return D.classify(D.occurrences(rows, "doc", "page", "t"), docs, "doc", F.col("name"))


SLUG_SQL = r"trim(regexp_replace(regexp_replace(translate(trim(regexp_replace(lower(regexp_replace(name, '([^.])\.[^.]*$', '\1')), '\s+', ' ', 'g')), 'áéíóúüñ', 'aeiouun'), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT p_partkey, {listed(NAMES)}[p_partkey % 5 + 1] AS name FROM part), s AS (SELECT p_partkey, {SLUG_SQL} AS base FROM n), t AS (SELECT *, trim(regexp_replace(base, '^\\s*\\d+[\\s.)_-]*', '')) AS plain FROM s),
u AS (SELECT *, CASE WHEN contains(plain, ' ') AND regexp_matches(plain, ' [a-z0-9]+(-[a-z0-9]+){{2,}}$') AND regexp_matches(regexp_extract(plain, '[^ ]*$'), '\\d') THEN trim(regexp_replace(plain, ' [^ ]*$', '')) ELSE plain END AS short FROM t)
SELECT DISTINCT p_partkey, unnest([base, plain, short]) AS alias FROM u""")
def file_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Names under which files may be cited."""
    name = F.element_at(F.lit(list(NAMES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.explode(D.alias_variants(name)).alias("alias"))


@query("""WITH r AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'IGNORE_REFERENCE' WHEN 1 THEN 'MARK_UNRESOLVED' WHEN 2 THEN 'RESOLVE_TO_DOCUMENT' END AS d, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey + 1 END AS ht, CASE p_partkey % 4 WHEN 0 THEN 'AUTO_RESOLVED' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'PENDING' END AS s, p_partkey + 2 AS t FROM part)
SELECT p_partkey, CASE WHEN d = 'IGNORE_REFERENCE' THEN 'IGNORED' WHEN d = 'MARK_UNRESOLVED' THEN 'UNRESOLVED' WHEN d = 'RESOLVE_TO_DOCUMENT' AND ht IS NOT NULL THEN 'HUMAN_RESOLVED' WHEN s IN ('AUTO_RESOLVED', 'AMBIGUOUS') THEN s ELSE 'UNRESOLVED' END AS status,
CASE WHEN d IN ('IGNORE_REFERENCE', 'MARK_UNRESOLVED') THEN NULL WHEN d = 'RESOLVE_TO_DOCUMENT' AND ht IS NOT NULL THEN ht WHEN s IN ('AUTO_RESOLVED', 'AMBIGUOUS') THEN t END AS target FROM r""")
def reference_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Which decision on a reference counts: a person's before the machine's."""
    k, d, s = F.col("p_partkey"), F.col("p_size") % 5, F.col("p_partkey") % 4
    decision = F.when(d == 0, "IGNORE_REFERENCE").when(d == 1, "MARK_UNRESOLVED").when(d == 2, "RESOLVE_TO_DOCUMENT")
    status, target = D.effective_reference(decision, F.when(k % 3 != 0, k + 1), F.when(s == 0, "AUTO_RESOLVED").when(s == 1, "AMBIGUOUS").when(s == 2, "PENDING"), k + 2)
    return table(spark, sf, "part").select("p_partkey", status.alias("status"), target.alias("target"))


@query(f"""WITH h AS (SELECT ['Se modifica el numeral', 'Véase el anexo', 'QUEDA SUSTITUYÉNDOSE', 'Sustituye a la anterior', 'Se  reemplaza'] AS hs) SELECT doc_id, CASE WHEN {any_of("translate(" + NORM.format("hs[doc_id % 5 + 1]") + ", 'áéíóúüñ', 'aeiouun')", D.MODIFICATION_CUES)} THEN 'MODIFIES' ELSE 'REFERENCES' END AS relation FROM documents, h""")
def relation_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a reference modifies what it names."""
    lines = ["Se modifica el numeral", "Véase el anexo", "QUEDA SUSTITUYÉNDOSE", "Sustituye a la anterior", "Se  reemplaza"]
    return table(spark, sf, "documents").select("doc_id", D.relation_cue(F.element_at(F.lit(lines), (F.col("doc_id") % 5 + 1).cast("int"))).alias("relation"))
