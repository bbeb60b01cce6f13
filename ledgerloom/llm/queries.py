"""The training-data operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, curves, langid, lm, mixing, nndescent, simhash, spelling, substring, trie_counts, urlgraph, vacodes, warc
from ledgerloom.llm.common import WORD, shared_dir, table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    return warc.captures_of(table(spark, sf_dir, "pages"), archives)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under piece_bpe_32k's pieces, each scored by minus the logarithm of its place, as the file holds no unigram probabilities."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return trie_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "strange")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vacodes.encode(table(spark, sf_dir, "embeddings")).drop("refined")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword ids by byte_bpe_multi_50k's ranks, each word behind a space."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_warc_captures": op2_warc_captures,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_source_mix": op7_source_mix,
    "op8_language_id": op8_language_id,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lm_scores": op13_lm_scores,
}


def url_filter_sql(rules: tuple[urlgraph.Rule, ...] = urlgraph.RULES, rounds: int = 8, damping: float = 0.85, threshold: float = 1.0) -> str:
    """op6 in SQL, its rounds unrolled: all there are where links only lead to hosts above, as in the test pages."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))
    fit = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ranked]
    which = " ".join(f"WHEN {f} THEN {k}" for k, f in enumerate(fit))
    names = " ".join(f"WHEN {k} THEN '{h}{p}'" for k, (_, h, p) in enumerate(ranked))
    verdicts = " ".join(f"WHEN {k} THEN '{v}'" for k, (v, _, _) in enumerate(ranked))
    low = lambda x: f"translate({x}, '{urlgraph.UPPER}', '{urlgraph.LOWER}')"
    href = urlgraph.HREF.replace("'", "''")
    steps = "".join(
        f""",
r{k + 1} AS MATERIALIZED (SELECT kind, node, sum(part) AS score FROM (SELECT e.kind, e.dst AS node, r.score * e.weight * {damping} AS part FROM r{k} r JOIN e ON e.kind = r.kind AND e.src = r.node
 UNION ALL SELECT kind, node, score * (1 - {damping}) FROM r0) GROUP BY 1, 2)"""
        for k in range(rounds)
    )
    return f"""WITH u AS (SELECT page_id, html, {low("coalesce(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)', 2), '')")} AS host, coalesce(regexp_extract(url, '(?s)^(.*?)://[^/?#]*([^?#]*)', 2), '') AS path FROM pages),
p AS MATERIALIZED (SELECT *, CASE {which} END AS fit FROM u), j AS (SELECT page_id, host, path, html, CASE fit {names} END AS rule, CASE fit {verdicts} END AS ruled FROM p),
hosts AS (SELECT DISTINCT host FROM j WHERE host <> ''),
l AS (SELECT host AS src, {low("unnest(regexp_extract_all(html, '" + href + "', 1))")} AS dst FROM j WHERE host <> ''),
n AS (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM l WHERE dst <> '' AND dst <> src UNION ALL SELECT h.host, a.host FROM hosts h JOIN hosts a ON a.host = regexp_replace(h.host, '^[^.]*\\.', '') AND a.host <> h.host) GROUP BY 1, 2),
e AS MATERIALIZED (SELECT 'allow' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM n UNION ALL SELECT 'block', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM n),
r0 AS MATERIALIZED (SELECT ruled AS kind, host AS node, count(*) / sum(count(*)) OVER (PARTITION BY ruled) AS score FROM j WHERE ruled IS NOT NULL AND host <> '' GROUP BY 1, 2){steps},
t AS (SELECT node, coalesce(sum(CASE WHEN kind = 'block' THEN share END), 0) - coalesce(sum(CASE WHEN kind = 'allow' THEN share END), 0) AS gap FROM (SELECT kind, node, score / sum(score) OVER (PARTITION BY kind) AS share FROM r{rounds}) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(gap, 0) * (SELECT count(*) FROM hosts) > {threshold} THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN t ON t.node = j.host"""


SOURCE_MIX_SQL = f"""WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
c AS (SELECT *, CASE WHEN size < 32 THEN size ELSE length(bin(size)) * 32 + (size >> (length(bin(size)) - 5)) END AS class, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 13) AS BIGINT) AS tie FROM s),
k AS (SELECT *, tie % CAST(ceil(count(*) OVER (PARTITION BY source, class) / {mixing.BLOCK_ROWS}) AS BIGINT) AS block FROM c),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s GROUP BY source),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM p),
f AS (SELECT *, sum(cap) OVER v AS caps, sum(weight) OVER v AS weights, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weights FROM w WINDOW v AS (ORDER BY cap / weight, place)),
g AS (SELECT *, caps + cap / weight * (all_weights - weights) <= budget AS is_full FROM f),
h AS (SELECT *, budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS rest, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS open FROM g),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, rest * weight / open) END AS target, CAST('0x' || left(md5('0|' || coalesce(source, '')), 13) AS BIGINT) / pow(2.0, 52) AS shift FROM h),
r AS (SELECT k.*, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY k.source ORDER BY class, block, size, tie, doc_id) AS place FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST(least(floor(place * rate + shift) - floor((place - 1) * rate + shift), 2) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, source FROM x"""



def vector_codes_sql(settings: vacodes.Settings = vacodes.Settings()) -> str:
    """op11 in SQL, its rounds unrolled; for vectors of one length that the parts divide."""
    s = settings
    nearest = """n{k} AS MATERIALIZED (SELECT vec_id, label, part, piece, min({{'d': d, 'entry': entry}}) AS best FROM
 (SELECT r.*, b.entry, list_sum(list_transform(list_zip(r.piece, b.piece), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM r JOIN b{k} b ON b.part = r.part) GROUP BY 1, 2, 3, 4)"""
    steps = "".join(
        f""", {nearest.format(k=k)},
m{k} AS MATERIALIZED (SELECT part, best.entry AS entry, place, floor_div(sum(piece[place]), count(*)) AS x FROM (SELECT n{k}.*, unnest(range(1, len(piece) + 1)) AS place FROM n{k}) GROUP BY 1, 2, 3),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.piece, b.piece) AS piece FROM b{k} b LEFT JOIN (SELECT part, entry, list(x ORDER BY place) AS piece FROM m{k} GROUP BY 1, 2) m USING (part, entry))"""
        for k in range(s.rounds)
    ).replace("floor_div(sum(piece[place]), count(*))", "((sum(piece[place]) - ((sum(piece[place]) % count(*)) + count(*)) % count(*)) // count(*))::HUGEINT")
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({s.scale} * x::DOUBLE)::HUGEINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS MATERIALIZED (SELECT vec_id, label, part, q[part * (len(q) // {s.parts}) + 1 : (part + 1) * (len(q) // {s.parts})] AS piece FROM (SELECT *, unnest(range({s.parts})) AS part FROM v)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, piece FROM r QUALIFY entry < {s.entries}){steps}, {nearest.format(k=s.rounds)},
e AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM n{s.rounds} GROUP BY 1, 2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(piece, ','), ',' ORDER BY part, entry)) FROM b{s.rounds}) AS codebooks_sha256 FROM e"""


#: crc32 of a text's bytes, a byte at a time; near words share what is left when one code point is taken from either or from the longer.
SPELLING_VARIANTS_SQL = """WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) r(i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
per_doc AS (SELECT doc, run, count(*) AS n, list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM runs GROUP BY 1, 2),
told AS (SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c // 256, crcs[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h FROM per_doc, crc),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM told) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT DISTINCT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT l.word, w.word FROM less l JOIN w ON w.word = l.rest UNION SELECT w.word, l.word FROM less l JOIN w ON w.word = l.rest),
near AS (SELECT a AS word, count(*) AS n_near, min({'m': -w.n, 'form': b}) AS top FROM pairs JOIN w ON w.word = b GROUP BY 1),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= 2 * n THEN top.form END AS form, CASE WHEN -top.m >= 2 * n THEN -top.m END AS form_n FROM w LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL) r USING (word)"""

ORACLES: dict[str, str] = {"op12_spelling_variants": SPELLING_VARIANTS_SQL, "op11_vector_codes": vector_codes_sql(), "op6_url_filter": url_filter_sql(), "op7_source_mix": SOURCE_MIX_SQL}
