"""Requirements out of spans dealt to parts, on pages of four kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import requirements as R
from ledgerloom.functions import tender as T
from ledgerloom.operators import spans, versions
from ledgerloom.operators.durable import roomy
from ledgerloom.plans.base import query, table

#: Parts of one task, where each is asked much.
PARTS = 20_000

SPANS = (
    "El licitante deberá presentar carta de respaldo del fabricante.", "La convocante deberá publicar el fallo en la fecha indicada.", "Documentos que deberá presentar el licitante:", "Presentar copia de la constancia fiscal vigente.",
    "presentar copia de la constancia fiscal vigente.", "El participante que resulte adjudicado deberá entregar la fianza.", "El proveedor entregará reportes mensuales de avance.", "Se requiere que la propuesta incluya el catálogo firmado.",
    "Será causa de desechamiento la falta de firma.", "No se aceptarán ofertas condicionadas de ningún tipo.", "El supervisor revisará y el contratista deberá atender sus notas.", "Índice general del contenido del documento", "Véase el numeral 4 de las bases.",
    "Deberá cumplir [nombre de la empresa] con lo previsto.", "Los licitantes acreditarán experiencia mínima de tres años.", "Es requisito.", "La oferta deberá: ok.", "Como parte de su propuesta, el adjudicado deberá incluir el programa.", "Cantidad de bombas instaladas en la planta norte.",
    "El licitante deberá acreditar la capacidad antes de que resulte adjudicado.", "Para cada partida; anexar ficha técnica de los bienes ofertados.", "Los servicios tendrán que iniciar a tiempo en la planta.",
    "de los trabajos similares ejecutados con personal técnico que", "Dicha documentación deberá presentarse en formato PDF firmada;", "El certificado y dicha documentación ISO 9001 del fabricante.", "| n x y z w b: garantía ¢ | �", "Propuesta económica con precios unitarios e importe y condiciones comerciales", "Presentación y apertura de propuestas comercial, técnica y económica",
)
PAGES = ("Generalidades del procedimiento", "Documentación requerida a los interesados", "Documentación del participante adjudicado", "Integrar su propuesta previo a la firma del contrato")


def prepared(x: str) -> str:
    return rf"trim(regexp_replace(translate(lower({x}), 'áéíóúüñ', 'aeiouun'), '\s+', ' ', 'g'))"


def has(p: str, of: str = "t") -> str:
    return f"regexp_matches({of}, '{p}')"


def found(p: str) -> str:
    return f"struct_pack(a := strpos(t, regexp_extract(t, '{p}')), w := regexp_extract(t, '{p}'))"


SPANS_SQL = f"""b AS (SELECT p_partkey, [{", ".join(repr(s) for s in SPANS)}][p_partkey % {len(SPANS)} + 1] AS raw, [{", ".join(repr(s) for s in PAGES)}][p_partkey // 22 % 4 + 1] AS pg, CASE WHEN p_partkey % 5 = 0 THEN 'CONTRACT_DRAFT' ELSE 'BIDDING_RULES' END AS kind FROM part),
s AS (SELECT p_partkey, kind, {prepared("raw")} AS t, {prepared("pg")} AS p, regexp_matches(raw, '^[a-z]') AS small FROM b),
o AS (SELECT *, CASE WHEN {has(R.IMPERATIVE_LATER)} THEN {found(R.IMPERATIVE_LATER)} ELSE list_min(list_filter([{", ".join(f"CASE WHEN {has(p)} THEN {found(p)} END" for p in R.OBLIGING)}], lambda x: x IS NOT NULL)) END AS said,
 CASE WHEN {has(R.AWARD_RESULT)} THEN strpos(t, regexp_extract(t, '{R.AWARD_RESULT}')) END AS award FROM s),
f AS (SELECT *, said.a AS pos, {has(R.BIDDER)} AS bidder, {has(R.REJECTION)} AS rejected, substr(t, greatest(said.a - 100, 1), least(said.a - 1, 100)) AS near, trim(substr(t, said.a + length(said.w)), ' :-,.;') AS tail FROM o),
g AS (SELECT *, coalesce(award > pos AND bidder AND {has(R.EXCEPTION_VERBS, "substr(t, 1, award)")}, FALSE) OR {has(R.PROPOSAL)} AS excepted, bidder OR {has(R.BIDDING)} AS relevant FROM f)"""


@query(f"""WITH {SPANS_SQL} SELECT p_partkey, CASE WHEN length(t) < 20 OR (ends_with(t, ':') AND {has(R.CHECKLIST)}) OR {has(R.PLACEHOLDER)} OR {has(R.FORM_FILLING)} OR {has(R.DEFINITION)} THEN 'NOISE' WHEN said IS NULL THEN 'NO_OBLIGATION' WHEN {has("^(?:" + R.AUTHORITY + ")")} OR {has("^(?:" + R.AWARDED + ")")} THEN 'OTHER_SUBJECT'
WHEN {has(R.IMPERATIVE_START)} AND small THEN 'NO_SUBJECT' WHEN {has(R.AUTHORITY, "near")} OR {has(R.AWARDED, "near")} THEN 'OTHER_SUBJECT_NEAR' WHEN ({has(R.AWARDED)} OR {has(R.AFTER_AWARD)}) AND NOT bidder THEN 'AFTER_AWARD' WHEN coalesce(award <= pos, FALSE) AND NOT excepted THEN 'AWARD_FORM'
WHEN ({has(R.AWARD_PAGE, "p")} OR (({has(R.AWARD_RESULT, "p")} OR {has(R.AFTER_AWARD, "p")}) AND NOT {has(R.PROPOSAL, "p")})) AND NOT excepted THEN 'AWARD_PAGE' WHEN {has(R.FORM_INSTRUCTION)} AND {has(R.FORM_PAGE, "p")} THEN 'FORM_INSTRUCTION'
WHEN {has(R.CONTRACT_KINDS, "kind")} AND NOT relevant AND NOT rejected THEN 'CONTRACT_TEXT' WHEN NOT rejected AND NOT relevant AND NOT ({has(R.IMPERATIVE_START)} AND {has(R.CHECKLIST, "p")}) THEN 'NOT_FOR_BIDDERS' WHEN NOT rejected AND length(tail) < 8 THEN 'NO_CONTENT' ELSE 'REQUIREMENT' END AS verdict,
CASE WHEN regexp_matches(said.w, '{R.ASKED}') THEN regexp_extract(said.w, '{R.ASKED}', 1) ELSE trim(said.w) END AS modality, coalesce(nullif(trim(regexp_extract(t, '{R.BIDDER}')), ''), nullif(trim(regexp_extract(t, '{R.AUTHORITY}')), ''), nullif(trim(regexp_extract(t, '{R.AWARDED}')), '')) AS actor FROM g""")
def requirement_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Which spans ask something of bidders, in what words, and of whom."""
    k = F.col("p_partkey")
    raw = F.element_at(F.lit(list(SPANS)), (k % len(SPANS) + 1).cast("int"))
    page = F.element_at(F.lit(list(PAGES)), (F.floor(k / 22) % 4 + 1).cast("int"))
    # a short row becomes some 70 looks for patterns, so a file that is one task as it is read is dealt to many
    parts = roomy(table(spark, sf, "part").select("p_partkey"), ["p_partkey"], F.lit(1), PARTS)
    rows = parts.select("p_partkey", T.plain(raw).alias("t"), T.plain(page).alias("p"), raw.rlike("^[a-z]").alias("small"), F.when(k % 5 == 0, "CONTRACT_DRAFT").otherwise("BIDDING_RULES").alias("kind"))
    return rows.select("p_partkey", R.verdict(F.col("t"), F.col("p"), F.col("kind"), F.col("small")).alias("verdict"), R.modality(R.obligation(F.col("t"))["words"]).alias("modality"), R.actor(F.col("t")).alias("actor"))


@query(r"""SELECT doc_id, CAST(len(x) AS BIGINT) AS spans, sha256(array_to_string(x, '|')) AS digest FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '') AS x FROM documents)""")
def text_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of whole texts."""
    x = R.spans(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(x).cast("long").alias("spans"), F.sha2(F.array_join(x, "|"), 256).alias("digest"))


def score_sql(name: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(k, '{w}') THEN {n} ELSE 0 END" for w, n in R.WEIGHTS[name].items()) + ")"


BEST_SQL = "greatest(" + ", ".join(f"s_{n}" for n in R.CATEGORIES) + ")"
CATEGORY_SQL = f"""{SPANS_SQL}, r AS (SELECT p_partkey, raw, t FROM b JOIN s USING (p_partkey)), k AS (SELECT *, regexp_replace(t, '{R.PROCEDURE}', ' ', 'g') AS k FROM r),
c0 AS (SELECT *, {", ".join(f"{score_sql(n)} AS r_{n}" for n in R.CATEGORIES)} FROM k),
c1 AS (SELECT *, {", ".join(f"r_{n} AS s_{n}" for n in R.CATEGORIES if n not in ("PERSONNEL", "EXPERIENCE"))}, r_PERSONNEL - CASE WHEN r_PERSONNEL > 0 AND r_EXPERIENCE > r_PERSONNEL THEN 1 ELSE 0 END AS s_PERSONNEL, r_EXPERIENCE - CASE WHEN r_EXPERIENCE > 0 AND r_PERSONNEL > 0 AND r_PERSONNEL >= r_EXPERIENCE THEN 1 ELSE 0 END AS s_EXPERIENCE FROM c0),
c2 AS (SELECT *, {BEST_SQL} AS best FROM c1), c3 AS (SELECT *, {" + ".join(f"CASE WHEN s_{n} = best THEN 1 ELSE 0 END" for n in R.CATEGORIES)} AS tied FROM c2),
c4 AS (SELECT p_partkey, raw, t, CASE WHEN best <= 0 THEN 'UNKNOWN' WHEN tied > 1 THEN CASE {" ".join(f"WHEN s_{n} = best AND regexp_matches(k, '{p}') THEN '{n}'" for n, p in R.TIES)} ELSE 'UNKNOWN' END {" ".join(f"WHEN s_{n} = best THEN '{n}'" for n in R.CATEGORIES)} END AS category FROM c3)"""
NOISY_SQL = " OR ".join(f"starts_with(raw, '{x}')" for x in ("|", "✓", "we ", "n ", "y ", "v "))


@query(f"""WITH {CATEGORY_SQL}, d AS (SELECT *, substr(raw, 1, 42) AS head, regexp_extract(t, '^([a-zñ]+)', 1) AS word, regexp_extract(t, '{R.REFERENT}') AS ref FROM c4)
SELECT p_partkey, category, array_to_string(list_filter([CASE WHEN {NOISY_SQL} OR len(regexp_extract_all(head, '\\b[a-zA-Z]\\b')) >= 6 THEN 'ocr_noise' END, CASE WHEN regexp_matches(raw, '{R.OPEN_END}') OR (length(raw) < 60 AND NOT regexp_matches(raw, '[.:]$')) THEN 'truncated_span' END,
CASE WHEN regexp_matches(raw, '^[a-záéíóúñ]') AND (word IN {R.CLIPPED} OR length(word) <= 2) THEN 'clipped_continuation' END, CASE WHEN regexp_matches(t, '{R.CONNECTOR}') THEN 'open_terminal_connector' END, CASE WHEN ref <> '' AND NOT regexp_matches(substr(t, 1, strpos(t, ref) - 1), '{R.ANTECEDENT}') THEN 'missing_context_antecedent' END,
CASE WHEN len(regexp_extract_all(raw, '{R.MALFORMED}')) >= 3 THEN 'malformed_chars' END, CASE WHEN category = 'UNKNOWN' THEN 'unknown_category' END], lambda x: x IS NOT NULL), ',') AS missing FROM d""")
def requirement_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Of what kind requirements are, and what they lack to stand on their own."""
    k = F.col("p_partkey")
    raw = F.element_at(F.lit(list(SPANS)), (k % len(SPANS) + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", raw.alias("raw"), T.plain(raw).alias("t")).withColumn("category", R.category(F.col("t")))
    return rows.select("p_partkey", "category", F.array_join(R.incomplete(F.col("raw"), F.col("t"), F.col("category")), ",").alias("missing"))


VERSIONS_SQL = """q AS (SELECT p_partkey AS requirement, p_partkey // 12 AS document, 'entregar ' || p_size || ' bombas' AS text, 'seccion ' || p_partkey % 5 || ' entregar' AS excerpt FROM part),
h AS (SELECT p_partkey AS change, p_partkey // 12 AS document, CASE WHEN p_partkey % 4 <> 0 THEN 'seccion ' || p_partkey % 5 END AS locator, p_size || ' bombas' AS before, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE (p_size + 1) || ' bombas' END AS after, CASE p_partkey % 9 WHEN 0 THEN 'ADDS' WHEN 3 THEN 'REMOVES' ELSE 'MODIFIES' END AS kind FROM part WHERE p_partkey % 3 = 0),
z AS (SELECT change, document, locator, 'before' AS side, before AS fragment FROM h UNION ALL SELECT change, document, locator, 'after', after FROM h),
m AS (SELECT change, side, requirement, CASE WHEN fragment <> '' AND contains(text, fragment) THEN 3 ELSE 0 END + CASE WHEN fragment <> '' AND contains(excerpt, fragment) THEN 3 ELSE 0 END + CASE WHEN contains(text, locator) THEN 2 ELSE 0 END + CASE WHEN contains(excerpt, locator) THEN 2 ELSE 0 END AS score FROM z JOIN q USING (document)),
x AS (SELECT change, side, max(score) AS score FROM m WHERE score > 0 GROUP BY 1, 2), y AS (SELECT x.change, x.side, x.score, count(*) AS n, min(requirement) AS target FROM x JOIN m ON m.change = x.change AND m.side = x.side AND m.score = x.score GROUP BY 1, 2, 3),
w AS (SELECT z.change, z.side, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status, CASE WHEN n = 1 THEN target END AS target FROM z LEFT JOIN y ON y.change = z.change AND y.side = z.side),
v AS (SELECT h.change, kind, b.status AS bs, b.target AS old, a.status AS st, a.target AS new FROM h JOIN w b ON b.change = h.change AND b.side = 'before' JOIN w a ON a.change = h.change AND a.side = 'after'),
l AS (SELECT change, CASE WHEN (kind <> 'ADDS' AND bs = 'AMBIGUOUS') OR (kind <> 'REMOVES' AND st = 'AMBIGUOUS') OR (kind = 'MODIFIES' AND old = new) THEN 'AMBIGUOUS' WHEN (kind <> 'ADDS' AND bs = 'UNRESOLVED') OR (kind <> 'REMOVES' AND st = 'UNRESOLVED') THEN 'UNRESOLVED' WHEN kind = 'ADDS' THEN 'INTRODUCES' WHEN kind = 'REMOVES' THEN 'RETIRES' ELSE 'SUPERSEDES' END AS link,
 CASE WHEN kind <> 'ADDS' THEN old END AS old, CASE WHEN kind <> 'REMOVES' THEN new END AS new FROM v)"""


def version_links_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k, size, part = F.col("p_partkey"), F.col("p_size").cast("string"), table(spark, sf, "part")
    document, place = F.floor(k / 12).alias("document"), F.concat(F.lit("seccion "), (k % 5).cast("string"))
    asked = part.select(k.alias("requirement"), document, F.concat(F.lit("entregar "), size, F.lit(" bombas")).alias("text"), F.concat(place, F.lit(" entregar")).alias("excerpt"))
    after = F.when(k % 6 == 0, "").otherwise(F.concat((F.col("p_size") + 1).cast("string"), F.lit(" bombas")))
    changes = part.where("p_partkey % 3 = 0").select(k.alias("change"), document, F.when(k % 4 != 0, place).alias("locator"), F.concat(size, F.lit(" bombas")).alias("before"), after.alias("after"), F.when(k % 9 == 0, "ADDS").when(k % 9 == 3, "REMOVES").otherwise("MODIFIES").alias("kind"))
    return asked, versions.links(versions.targets(changes, asked), changes.select("change", "kind"))


@query(f"WITH {VERSIONS_SQL} SELECT change, link, old, new FROM l")
def version_links(spark: SparkSession, sf: str) -> DataFrame:
    """What each change of the texts does to requirements."""
    return version_links_of(spark, sf)[1]


@query(f"""WITH {VERSIONS_SQL}, e AS (SELECT old AS requirement, link, TRUE AS is_old FROM l WHERE old IS NOT NULL UNION ALL SELECT new, link, FALSE FROM l WHERE new IS NOT NULL), g AS (SELECT requirement, bool_or(link = 'AMBIGUOUS') AS a, bool_or(link = 'UNRESOLVED') AS u, bool_or(is_old AND link IN ('SUPERSEDES', 'RETIRES')) AS s FROM e GROUP BY 1)
SELECT q.requirement, CASE WHEN a THEN 'AMBIGUOUS' WHEN u THEN 'UNRESOLVED' WHEN s THEN 'SUPERSEDED' ELSE 'EFFECTIVE' END AS status FROM q LEFT JOIN g USING (requirement)""")
def requirement_versions(spark: SparkSession, sf: str) -> DataFrame:
    """What each requirement is worth after all changes."""
    asked, linked = version_links_of(spark, sf)
    return versions.status(asked, linked)


#: Lines of pages, dealt to the lines of orders: headings, bullets, obligations, blanks and garbled lines.
LINES = (
    "Documentos que deberá presentar el licitante:", "Presentar {q} copias de la constancia fiscal vigente; firmadas.", "- El licitante deberá acreditar {q} años de experiencia. Es requisito contar con personal.", "a b c d e", "",
    "de la propuesta técnica y sus {q} anexos", "3) Se requiere garantía por {q} por ciento.", "   No se aceptarán   ofertas condicionadas;  ni parciales de {q} bombas.  ", "--", "IV. Alcance de los trabajos en la planta norte",
    "anexar ficha técnica de los {q} equipos ofertados", "Los servicios similares ejecutados se enlistan en el formato.", "Requisitos y criterios:", "x\tEl participante presentará {q} cartas.\rEl contratista entregará reportes.",
)


def order_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(o, page): a page for each order, of a line of text for each of its lines."""
    k = F.col("l_partkey") + F.col("l_linenumber")
    line = F.replace(F.element_at(F.lit(list(LINES)), (k % len(LINES) + 1).cast("int")), F.lit("{q}"), F.col("l_quantity").cast("int").cast("string"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), k.alias("k"), line.alias("line"))
    return rows.groupBy("o").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n", "k", "line")))["line"], "\n").alias("page"))


ORDER_PAGES_SQL = f"""lines AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey + l_linenumber AS k, CAST(l_quantity AS INT) AS q FROM lineitem),
pages AS (SELECT o AS id, string_agg(replace([{", ".join("'" + x + "'" for x in LINES)}][k % {len(LINES)} + 1], '{{q}}', CAST(q AS VARCHAR)), chr(10) ORDER BY n, k, CAST(q AS VARCHAR)) AS page FROM lines GROUP BY o)"""


def blocks_sql(pages: str) -> str:
    """Spans of pages (id, page) as a digest of each page's."""
    any_of = " OR ".join(f"regexp_matches(t, '{p}')" for p in (*R.OBLIGING, R.IMPERATIVE_LATER))
    w = "PARTITION BY id ORDER BY no"
    return rf"""WITH {pages},
l0 AS (SELECT id, unnest(x) AS raw, unnest(range(len(x))) AS no FROM (SELECT id, string_split_regex(page, '[
]') AS x FROM pages WHERE page IS NOT NULL)),
l1 AS (SELECT *, coalesce(sum(length(raw) + 1) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS c, {prepared("raw")} AS t FROM l0),
l2 AS (SELECT *, sum(CASE WHEN c = '' THEN 1 ELSE 0 END) OVER ({w}) AS gap, len(list_filter(string_split_regex(c, '[^\pL\pN_]+'), lambda x: regexp_matches(x, '{spans.LONE}'))) AS lone, len(regexp_extract_all(c, '{spans.LETTERS}')) AS letters FROM l1),
l3 AS (SELECT *, regexp_matches(t, '{R.CHECKLIST}') AND ends_with(c, ':') AS head, regexp_matches(c, '{spans.BULLET}') AS bullet, {any_of} AS anchor FROM l2 WHERE c <> '' AND NOT (length(c) <= 3 OR (lone >= 4 AND letters <= 18) OR (letters = 0 AND length(c) < 12))),
l4 AS (SELECT *, NOT head AND coalesce(lag(head) OVER ({w}) AND lag(gap) OVER ({w}) = gap, FALSE) AS joined, coalesce(lag(gap) OVER ({w}) < gap, TRUE) AS fresh FROM l3),
l5 AS (SELECT *, head OR (NOT joined AND (bullet OR fresh)) AS sure FROM l4), l6 AS (SELECT *, sum(CAST(sure AS INT)) OVER ({w}) AS part FROM l5),
l7 AS (SELECT *, sure OR (NOT joined AND anchor AND coalesce(sum(CAST(anchor AS INT)) OVER (PARTITION BY id, part ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0) AS begins, coalesce(lead(joined) OVER ({w}), FALSE) AS followed FROM l6),
l8 AS (SELECT *, sum(CAST(begins AS INT)) OVER ({w}) AS block FROM l7), p0 AS (SELECT id, no, pos0, block, unnest(x) AS piece, unnest(range(len(x))) AS k FROM (SELECT *, regexp_extract_all(raw, '(?s).+?[.;]\s+|.+') AS x FROM l8 WHERE NOT head OR followed)),
p1 AS (SELECT *, pos0 + coalesce(sum(length(piece)) OVER (PARTITION BY id, no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS s, trim(regexp_replace(piece, '\s+', ' ', 'g')) AS text FROM p0),
p2 AS (SELECT *, s + length(regexp_replace(piece, '^\s+|\s+$', '', 'g')) AS e, coalesce(regexp_matches(lag(text) OVER (PARTITION BY id, block ORDER BY no, k), '[.;]$'), TRUE) AS first FROM p1),
p3 AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY id, block ORDER BY no, k) AS sentence FROM p2),
p4 AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY id, block, sentence) - 1 AS size, sum(length(text) + 1) OVER (PARTITION BY id, block) - 1 AS whole FROM p3),
p5 AS (SELECT *, sum(CASE WHEN first AND size >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY id, block) AS useful FROM p4),
g AS (SELECT id, block, CASE WHEN useful <= 1 THEN 0 ELSE sentence END AS span, string_agg(CAST(s AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY s) || ':' || string_agg(text, ' ' ORDER BY s) AS told FROM p5 WHERE whole >= 20 AND (useful <= 1 OR size >= 20) GROUP BY 1, 2, 3)
SELECT p.id, count(told) AS spans, sha256(coalesce(string_agg(told, '|' ORDER BY block, span), '')) AS digest FROM pages p LEFT JOIN g USING (id) GROUP BY 1"""


def digests(pages: DataFrame, key: str, text: str) -> DataFrame:
    """id, spans, digest of each page."""
    found = spans.spans(pages, [key], text)
    told = F.concat(F.array_join(F.transform("places", lambda p: F.concat_ws("-", p["start"], p["end"])), ","), F.lit(":"), F.col("text"))
    sums = found.groupBy(key).agg(F.count("*").alias("spans"), F.sort_array(F.collect_list(F.struct("block", "span", told.alias("told"))))["told"].alias("all"))
    out = pages.select(key).join(sums, key, "left")
    return out.select(F.col(key).alias("id"), F.coalesce("spans", F.lit(0)).cast("long").alias("spans"), F.sha2(F.coalesce(F.array_join("all", "|"), F.lit("")), 256).alias("digest"))


@query(blocks_sql("pages AS (SELECT doc_id AS id, text AS page FROM documents)"))
def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks and their spans in whole texts, with their places."""
    return digests(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query(blocks_sql(ORDER_PAGES_SQL))
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks and their spans in pages of headings, bullets and obligations."""
    return digests(order_pages(spark, sf), "o", "page")
