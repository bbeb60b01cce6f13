"""Text operators over the documents, pages and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import chunks, equivalence, imports, match, materialise, readiness, rollup, rules
from ledgerloom.operators.durable import shared_dir
from ledgerloom.plans.base import query, table

#: NFC, then line ends, then white space at them, outer white space, empty lines, and characters of category C.
TIDY = "nfc_normalize(coalesce(text, ''))"
for _pattern, _by in ((r"\r\n?", "chr(10)"), (r"[\t\v\f\x1c-\x1f\x{85}\p{Z}]+(\n|$)", r"'\1'"), (r"^[\n\t\v\f\x1c-\x1f\x{85}\p{Z}]+|[\n\t\v\f\x1c-\x1f\x{85}\p{Z}]+$", "''"), (r"\n{3,}", "chr(10) || chr(10)"), (r"[^\n\P{C}]", "''"), (r"^[\n\p{Z}]+|[\n\p{Z}]+$", "''")):
    TIDY = f"regexp_replace({TIDY}, '{_pattern}', {_by}, 'g')"


@query(f"SELECT doc_id, sha256({TIDY}) AS fingerprint, CAST(length({TIDY}) AS BIGINT) AS n_chars FROM documents")
def doc_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Ingestion text: tidied lines, its hash and its length."""
    t = X.tidy_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("fingerprint"), F.length(t).cast("long").alias("n_chars"))


@query("SELECT doc_id, sha256(concat_ws('|', trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), lang, source)) AS fingerprint FROM documents")
def doc_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.digest(X.matching(F.col("text")), F.col("lang"), F.col("source")).alias("fingerprint"))


@query(r"""SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, CAST(len(regexp_extract_all(line, '[^ \t]+')) AS BIGINT) AS words, round(CASE WHEN len(regexp_extract_all(line, '\p{L}')) = 0 THEN 0 ELSE len(regexp_extract_all(line, '\p{Lu}')) / len(regexp_extract_all(line, '\p{L}')) END, 6) AS upper_ratio
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE line <> ''""")
def doc_line_stats(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    return lines.select("doc_id", F.col("pos").cast("long"), F.regexp_count("line", F.lit(r"[^ \t]+")).cast("long").alias("words"), F.round(X.upper_ratio(F.col("line")), 6).alias("upper_ratio"))


@query("""SELECT doc_id, CASE WHEN h > 1 THEN 'DUPLICATE' WHEN n > 1 THEN 'NAME_CONFLICT' ELSE 'IMPORTED' END AS status FROM (SELECT doc_id,
row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS h, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)""")
def doc_import_status(spark: SparkSession, sf: str) -> DataFrame:
    """DUPLICATE content, NAME_CONFLICT of other content under a name that is taken, else IMPORTED."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.concat_ws("/", "source", "lang").alias("name"))
    return imports.classify(docs, "sha", "name", "doc_id").select("doc_id", "status")


#: type, term, weight
RULES = (("LICENCE", "license", 35), ("LICENCE", "copyright", 10), ("CONTACT", "@", 35), ("CONTACT", "phone", 10), ("SECRET", "key", 12), ("SECRET", "password", 35), ("NOTICE", "the", 4), ("NOTICE", "terms", 8))
RULE_ROWS = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in RULES)


@query(f"""WITH r(kind, term, weight) AS (VALUES {RULE_ROWS}), s AS (SELECT doc_id, kind, CAST(sum(weight) AS BIGINT) AS score FROM documents JOIN r ON contains(lower(text), term) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind) AS n FROM s WHERE score >= 35)
SELECT d.doc_id, coalesce(b.kind, 'UNKNOWN') AS kind, coalesce(b.score, 0) AS score FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND n = 1""")
def doc_classify_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the rules that a text meets, summed by type; the best type of 35 or more, else UNKNOWN."""
    return rules.classify(table(spark, sf, "documents"), "doc_id", "text", RULES, 35)


@query(r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._]+@[a-z0-9.]+')) AS ref FROM documents), c AS (SELECT ref, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM x GROUP BY 1)
SELECT x.doc_id, x.ref, count(*) AS n, CASE WHEN c.docs = 1 THEN 'UNRESOLVED' WHEN c.docs = 2 THEN 'AUTO' ELSE 'AMBIGUOUS' END AS status FROM x JOIN c USING (ref) GROUP BY 1, 2, 4""")
def doc_reference_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """References found in texts, and how many other documents each leads to: none, one or several."""
    found = rules.references(table(spark, sf, "documents"), "doc_id", F.lower("text"), r"([a-z0-9._]+@[a-z0-9.]+)")
    counts = found.groupBy("doc_id", "alias").agg(F.count("*").alias("n"))
    refs = counts.withColumn("ref_id", F.struct("doc_id", "alias"))
    told = match.by_alias(refs.select("ref_id", "doc_id", "alias"), counts.select("doc_id", "alias"), "ref_id", "doc_id")
    told = told.select(F.col("ref_id.doc_id").alias("doc_id"), F.col("ref_id.alias").alias("alias"), "status")
    return counts.join(told, ["doc_id", "alias"]).select("doc_id", F.col("alias").alias("ref"), "n", "status")


@query(r"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark), c AS (SELECT item_id, w, least(len(w), 8) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM c)), d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents)
SELECT DISTINCT d.doc_id, g.item_id FROM d JOIN g ON contains(d.t, ' ' || g.run || ' ')""")
def doc_contains_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold eight words in a row of a benchmark passage, or a shorter one whole, by an equi-join on word runs."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return match.holds_run(docs, "doc_id", "text", items, "item_id", "text", 8)


def word_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_distinct(X.words(F.col("text"))).alias("w"))


WORD_SETS_SQL = r"t AS (SELECT min(doc_id) AS doc_id, w FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM documents) GROUP BY w)"


@query(f"""WITH {WORD_SETS_SQL}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(a.w) + len(b.w) AS total, len(list_intersect(a.w, b.w)) AS common FROM t a JOIN t b ON a.doc_id < b.doc_id AND 2 * len(a.w) >= len(b.w) AND 2 * len(b.w) >= len(a.w))
SELECT a, b, round(common / (total - common), 4) AS similarity FROM p WHERE common / (total - common) >= 0.5""")
def doc_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of word sets that overlap by half, whatever their languages and lengths. Documents of one set are a class, named by its smallest id."""
    return match.jaccard_pairs(match.token_classes(word_sets(spark, sf), "doc_id", "w"), 0.5)


@query(f"""WITH {WORD_SETS_SQL}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(a.w) + len(b.w) AS total, len(list_intersect(a.w, b.w)) AS common FROM t a JOIN t b ON a.doc_id < b.doc_id AND len(a.w) >= 0.8 * len(b.w) AND len(b.w) >= 0.8 * len(a.w))
SELECT a, b, round(common / (total - common), 4) AS similarity FROM p WHERE common / (total - common) >= 0.8""")
def doc_near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of word sets that overlap by four fifths: near copies. Only the rarest fifth of the words has to meet."""
    return match.jaccard_pairs(match.token_classes(word_sets(spark, sf), "doc_id", "w"), 0.8)


@query(r"""SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')))) AS class FROM documents""")
def doc_word_classes(spark: SparkSession, sf: str) -> DataFrame:
    """To which class of equal word sets each document belongs."""
    found = match.token_classes(word_sets(spark, sf), "doc_id", "w")
    return found.select(F.col("__id").alias("doc_id"), F.col("__class").alias("class"))


@query("""SELECT d.lang, count(*) AS docs, count(l.quality) AS labelled, round(sum(l.quality) / nullif(count(l.quality), 0), 4) AS quality_rate,
round(sum(CASE WHEN l.toxic = 1 AND d.n_chars < 1500 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN l.toxic IS NOT NULL AND d.n_chars < 1500 THEN 1 ELSE 0 END), 0), 4) AS precision,
round(sum(CASE WHEN l.toxic = 1 AND d.n_chars < 1500 THEN 1 ELSE 0 END) / nullif(sum(l.toxic), 0), 4) AS recall FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def doc_quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Rates per language, and precision and recall of a rule (short texts) against the labels; null over nothing."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    told = F.col("n_chars") < 1500
    hit = F.sum(F.when((F.col("toxic") == 1) & told, 1).otherwise(0))
    return rows.groupBy("lang").agg(
        F.count("*").alias("docs"), F.count("quality").alias("labelled"), rollup.ratio(F.sum("quality"), F.count("quality")).alias("quality_rate"),
        rollup.ratio(hit, F.sum(F.when(F.col("toxic").isNotNull() & told, 1).otherwise(0))).alias("precision"), rollup.ratio(hit, F.sum("toxic")).alias("recall"),
    )


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def html_literal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha2(X.html_text(F.col("html")), 256).alias("digest"))


@query(r"""SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'SCHEME' WHEN NOT regexp_matches(url, '^https://([^/?#]*\.)?example\.(com|net|org)([/?#]|$)') THEN 'HOST' WHEN contains(url, '..') OR regexp_matches(url, '[\x00-\x20\\]') THEN 'PATH' WHEN contains(url, '?') THEN 'QUERY' ELSE 'ALLOWED' END AS verdict FROM pages""")
def url_policy(spark: SparkSession, sf: str) -> DataFrame:
    """What a download's address breaks first: scheme, host, path, query; or ALLOWED."""
    return table(spark, sf, "pages").select("page_id", rules.url_verdict(F.col("url"), ("example.com", "example.net", "example.org")).alias("verdict"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) >= 4 AND len(regexp_extract_all(text, '\p{L}')) >= len(regexp_extract_all(text, '[^\s]')) * 0.45 AND NOT contains(text, chr(65533)) AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') AS readable FROM documents""")
def doc_readable(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.readable(F.col("text")).alias("readable"))


@query(r"""SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(the|und)([^\p{L}\p{N}_]|$)') AND NOT regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(license)([^\p{L}\p{N}_]|$)') AS matched FROM documents""")
def profile_match(spark: SparkSession, sf: str) -> DataFrame:
    """Some include term and no exclude term as whole words."""
    return table(spark, sf, "documents").select("doc_id", rules.profile(F.col("text"), ("the", "und"), ("license",)).alias("matched"))


@query("""WITH i AS (SELECT DISTINCT o_orderkey, CAST(o_orderkey % 7 AS VARCHAR) || '.' || CAST(o_custkey % 11 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '.' || CAST(o_orderkey % 5 AS VARCHAR) END AS number FROM orders)
SELECT number, count(*) AS n, CASE WHEN contains(number, '.') THEN regexp_replace(number, '\\.[^.]*$', '') END AS parent, CAST(len(string_split(number, '.')) AS BIGINT) AS depth FROM i GROUP BY 1""")
def hierarchy_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted item numbers without leading zeros, their parents and depths."""
    pad = lambda c, n: F.lpad((F.col(c) % n).cast("string"), 3, "0")
    tail = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("."), pad("o_orderkey", 5)))
    raw = F.concat(pad("o_orderkey", 7), F.lit("."), pad("o_custkey", 11), tail, F.lit("."))
    number = X.item_number(raw)
    counts = table(spark, sf, "orders").select(number.alias("number")).groupBy("number").agg(F.count("*").alias("n"))
    return counts.select("number", "n", X.item_parent(F.col("number")).alias("parent"), X.item_depth(F.col("number")).cast("long").alias("depth"))


@query("""WITH w AS (SELECT *, lag(role) OVER v AS before FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM w)
SELECT conv_id, turn, CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS in_run FROM g""")
def ordered_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Turns carry their run on while the role stays; another role resets it."""
    return chunks.runs(table(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "run", "in_run")


@query()
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping chunks cut at white space: a place depends on the one before, so no SQL."""
    return chunks.chunk(table(spark, sf, "documents"), "doc_id", "text")


@query()
def fold_accents(spark: SparkSession, sf: str) -> DataFrame:
    """Case-folded text without combining marks, and its hash."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.folded(X.nfc(F.col("text"))), 256).alias("digest"))


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(id, line): all lines of all documents."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select((F.col("doc_id") * 100_000 + F.col("at")).alias("id"), "line")


@query()
def cluster_equivalent(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy groups of lines that say the same, over all lines of all documents, whatever their source, language and length."""
    pairs, members = equivalence.same_pairs(text_lines(spark, sf), "id", F.col("line"))
    return equivalence.groups(pairs, members)


#: What each document says of a date, by its id: all written forms, a month, a year, impossible days and none.
DATES = ("Entrega el {d}/{m}/{y} a las 10:00", "Firmado el {d} de {n} de {y}", "EL {d} DE {n} DEL {y}", "visita {d}-{n}-{y}", "en {n} de {y}", "durante {y}", "el 31/02/{y}", "el 30 de febrero de {y}", "sin fecha")


@query(f"""WITH k AS (SELECT doc_id, CAST(1 + doc_id % 28 AS INT) AS d, CAST(1 + doc_id % 12 AS INT) AS m, CAST(1990 + doc_id % 40 AS INT) AS y, doc_id % 9 AS f FROM documents)
SELECT doc_id, CASE WHEN f < 4 THEN strftime(make_date(y, m, d), '%Y-%m-%d') WHEN f = 4 THEN strftime(make_date(y, m, 1), '%Y-%m-%d') WHEN f = 5 THEN strftime(make_date(y, 1, 1), '%Y-%m-%d') END AS day, CASE WHEN f < 4 THEN 'DAY' WHEN f = 4 THEN 'MONTH' WHEN f = 5 THEN 'YEAR' ELSE 'UNKNOWN' END AS precision FROM k""")
def date_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Dates out of sentences that name them in several forms, or name none."""
    k = F.col("doc_id")
    text = F.element_at(F.lit(list(DATES)), (k % 9 + 1).cast("int"))
    name = F.element_at(F.lit(list(X.MONTHS)), (k % 12 + 1).cast("int"))
    for mark, by in (("{d}", (k % 28 + 1).cast("string")), ("{m}", (k % 12 + 1).cast("string")), ("{y}", (k % 40 + 1990).cast("string")), ("{n}", name)):
        text = F.replace(text, F.lit(mark), by)
    value, kind = X.spanish_date(text)
    return table(spark, sf, "documents").select("doc_id", F.date_format(value, "yyyy-MM-dd").alias("day"), kind.alias("precision"))


UNITS = ("piezas", "PZA.", "m2", "Kg", "cajas", "horas")


@query(f"""WITH u AS (SELECT p_partkey, p_size, [{", ".join(repr(u) for u in UNITS)}][CAST(p_partkey % 6 AS INT) + 1] AS unit, p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AS whole FROM part)
SELECT p_partkey, CASE WHEN whole THEN CASE WHEN p_partkey % 4 = 0 THEN p_size || '.5' ELSE CAST(p_size AS VARCHAR) END END AS amount, CASE WHEN whole THEN unit END AS unit, CASE WHEN whole THEN CASE unit WHEN 'piezas' THEN 'COUNT' WHEN 'PZA.' THEN 'COUNT' WHEN 'm2' THEN 'AREA' WHEN 'Kg' THEN 'MASS' WHEN 'horas' THEN 'DURATION' END END AS kind FROM u""")
def terminal_quantity(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities at the end of a text, and what their units measure; such as stand elsewhere or have a comma don't count."""
    k = F.col("p_partkey")
    number = F.concat(F.col("p_size").cast("string"), F.when(k % 11 == 0, ",5").when(k % 4 == 0, ".5").otherwise(""))
    text = F.concat(F.col("p_name"), F.lit(" ("), number, F.lit("  "), F.element_at(F.lit(list(UNITS)), (k % 6 + 1).cast("int")), F.when(k % 13 == 0, ") y más").when(k % 2 == 0, "). ").otherwise(")"))
    amount, unit = X.terminal_quantity(text)
    return table(spark, sf, "part").select("p_partkey", amount.alias("amount"), unit.alias("unit"), X.measure_kind(unit).alias("kind"))


@query("""SELECT doc_id, CASE WHEN contains(t, 'the') THEN substr(t, greatest(strpos(t, 'the') - 40, 1), strpos(t, 'the') + 40 - greatest(strpos(t, 'the') - 40, 1)) END AS excerpt FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)""")
def excerpt_window(spark: SparkSession, sf: str) -> DataFrame:
    t = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    at = F.instr(t, "the")
    return table(spark, sf, "documents").select("doc_id", F.when(at > 0, X.excerpt(t, at, 40, 40)).alias("excerpt"))


@query("""SELECT page_id, CASE WHEN page_id % 4 <> 3 THEN page_id END AS page, CASE WHEN page_id % 4 IN (0, 3) THEN CAST(page_id % 10 + 1 AS INT) END AS first, CASE WHEN page_id % 4 IN (0, 3) THEN CAST(page_id % 10 + 6 AS INT) END AS last, CASE WHEN page_id % 4 = 2 THEN 'A' || page_id END AS cell FROM pages""")
def locator_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Places in documents: pages, lines, cells, in any order."""
    k = F.col("page_id")
    page, lines = F.concat(F.lit("page:"), k.cast("string")), F.concat(F.lit("lines:"), (k % 10 + 1).cast("string"), F.lit("-"), (k % 10 + 6).cast("string"))
    raw = F.when(k % 4 == 0, F.concat_ws("|", page, lines)).when(k % 4 == 1, page).when(k % 4 == 2, F.concat_ws("|", F.concat(F.lit("cell:A"), k.cast("string")), page)).otherwise(lines)
    parts = X.locator(raw)
    span = F.split(parts["lines"], "-")
    return table(spark, sf, "pages").select("page_id", parts["page"].cast("long").alias("page"), span[0].cast("int").alias("first"), span[1].cast("int").alias("last"), parts["cell"].alias("cell"))


READABLE_SQL = r"len(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) >= 4 AND len(regexp_extract_all(text, '\p{L}')) >= len(regexp_extract_all(text, '[^\s]')) * 0.45 AND NOT contains(text, chr(65533)) AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')"


@query(f"""WITH d AS (SELECT doc_id, doc_id % 3 AS k, CASE WHEN doc_id % 10 = 9 THEN ' ' ELSE text END AS text, doc_id % 17 <> 0 AS supported, doc_id % 19 = 0 AS spatial, doc_id % 23 = 0 AS region, CASE doc_id % 7 WHEN 1 THEN 'the' WHEN 2 THEN 'no such words' END AS x, doc_id % 11 = 0 AS task, doc_id % 13 = 0 AS blocks FROM documents),
s AS (SELECT doc_id, CASE WHEN NOT supported THEN 'UNAVAILABLE|UNSUPPORTED_NATIVE_CAPABILITY' WHEN spatial THEN 'VISUAL_REQUIRED|EXPLICIT_SPATIAL_RELATIONSHIP_REQUIRED' WHEN region THEN 'INSUFFICIENT|REQUESTED_REGION_TEXT_NOT_COVERED' WHEN x IS NOT NULL AND contains(text, x) THEN 'SUFFICIENT|GROUNDED_TASK_EXCERPTS_PRESENT' WHEN x IS NOT NULL THEN 'INSUFFICIENT|REQUIRED_TEXT_NOT_AVAILABLE'
WHEN task AND text <> ' ' THEN 'UNKNOWN|TEXT_TASK_CONTRACT_REQUIRED' WHEN text = ' ' THEN 'INSUFFICIENT|TEXT_NOT_AVAILABLE' WHEN blocks THEN 'SUFFICIENT|GROUNDED_STRUCTURED_FRAGMENTS_AVAILABLE' WHEN {READABLE_SQL} THEN 'SUFFICIENT|CANONICAL_TEXT_READABLE_FOR_TASK_ATTEMPT' ELSE 'INSUFFICIENT|TEXTUAL_COVERAGE_NOT_ESTABLISHED' END AS v FROM d)
SELECT doc_id, string_split(v, '|')[1] AS state, string_split(v, '|')[2] AS reason FROM s""")
def text_sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each text is enough for the task that is asked of it, and why."""
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").withColumn("text", F.when(k % 10 == 9, " ").otherwise(F.col("text")))
    excerpts = F.when(k % 7 == 1, F.array(F.lit("the"))).when(k % 7 == 2, F.array(F.lit("no such words"))).otherwise(F.array().cast("array<string>"))
    state, reason = readiness.sufficiency(F.col("text"), X.readable(F.col("text")), k % 17 != 0, k % 19 == 0, k % 23 == 0, excerpts, k % 11 == 0, k % 13 == 0)
    return docs.select("doc_id", state.alias("state"), reason.alias("reason"))


def term_sql(text: str, term: str) -> str:
    return rf"regexp_matches(lower({text}), '(^|[^\p{{L}}\p{{N}}_]){term}([^\p{{L}}\p{{N}}_]|$)')"


HITS_SQL = " + ".join(f"CASE WHEN {term_sql(f, t)} THEN 1 ELSE 0 END" for t in ("the", "les", "los") for f in ("text", "source"))


@query(f"""WITH d AS (SELECT doc_id, {HITS_SQL} AS yes, CASE WHEN {term_sql("text", "license")} OR {term_sql("source", "license")} OR {term_sql("text", "src3")} OR {term_sql("source", "src3")} THEN 1 ELSE 0 END AS no, concat_ws(',', CASE WHEN lang = 'es' THEN 'AREA_RESTRICTION' END, CASE WHEN doc_id % 50 = 0 THEN 'PROFILE_INACTIVE' END) AS r FROM documents)
SELECT doc_id, r = '' AND no = 0 AND yes > 0 AS matched, CAST(yes AS INT) AS hits, r AS restrictions FROM d""")
def profile_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles over several fields: synonyms count as their term, an excluded term and restrictions outweigh."""
    told = rules.profile_match({"text": F.col("text"), "source": F.col("source")}, ("the",), ("license", "src3"), {"the": ("les", "los")}, (F.col("lang") == "es", "AREA_RESTRICTION"), (F.col("doc_id") % 50 == 0, "PROFILE_INACTIVE"))
    rows = table(spark, sf, "documents").select("doc_id", told.alias("p"))
    return rows.select("doc_id", "p.matched", F.size("p.included").alias("hits"), F.array_join("p.restrictions", ",").alias("restrictions"))


@query(r"""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, md5(text) AS digest, doc_id % 10 = 3 OR doc_id % 50 = 7 AS rebuilt FROM documents""")
def refreshed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all documents after a refresh: some had another text before, some weren't there, some have gone since; only these are built again."""
    docs, home = table(spark, sf, "documents").select("doc_id", "text"), f"{shared_dir(spark).rstrip('/')}/refreshed-{uuid.uuid4().hex}"
    i = F.col("doc_id")
    before = docs.where(i % 50 != 7).withColumn("text", F.when(i % 10 == 3, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))).unionByName(docs.where(i % 20 == 1).withColumn("doc_id", -i - 1))
    build = lambda some: some.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.md5(F.col("text").cast("binary")).alias("digest"))
    materialise.refresh(before, "doc_id", ["text"], build, home)
    told = materialise.refresh(docs, "doc_id", ["text"], build, home)
    return told.rows.join(told.built.withColumn("rebuilt", F.lit(True)), "doc_id", "left").fillna({"rebuilt": False})
