"""What shows on larger tables only: keys beyond a million, groups of copies, plans that would send much to one place."""

import difflib
import random

import duckdb
from pyspark.sql import functions as F

from ledgerloom.operators import discovery, equivalence, graph, labelled, match
from ledgerloom.operators.durable import stored
from ledgerloom.plans import registry, requirements
from test_queries import rows


def same_as_sql(spark, home, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{home}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{home}/{table}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(home)), con.execute(registry.ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())
    return got


def test_first_of_a_scan_where_part_keys_exceed_a_million(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1_500_000, 1), (1, 3, 2), (1, 3, 2), (2, 7, 2), (2, 9, 1)], "l_orderkey long, l_partkey long, l_linenumber int")
    got = same_as_sql(spark, tmp_path, "scan_first_wins", lineitem=lines)
    assert {(r.l_orderkey, r.l_partkey, r.repeats, r.conflicts) for r in got.collect()} == {(1, 3, 2, 1), (2, 9, 1, 1)}


def test_pairs_of_one_family_are_listed_by_several_tasks(spark, tmp_path):
    part = spark.range(600).selectExpr("id AS p_partkey", "'b' AS p_brand", "CAST(id % 12 AS INT) AS p_size")
    got = same_as_sql(spark, tmp_path, "evidence_match", part=part)
    assert got.select(F.spark_partition_id()).distinct().count() > 2


def test_boxes_that_are_alike_meet_once_and_in_several_tasks(spark, tmp_path):
    part = spark.range(3000).selectExpr("id AS p_partkey", "CAST(id % 9 AS INT) AS p_size")
    got = same_as_sql(spark, tmp_path, "box_containment", part=part)
    assert got.select(F.spark_partition_id()).distinct().count() > 2


def test_packs_hold_all_ids_nulls_and_repeats_included(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None), (3, None)] + [(k, "z") for k in range(5000)], "id long, k string")
    packs = match.packed(df, ["k"], "id").collect()
    assert sorted((r.k or "", x.id if x.id is not None else -1) for r in packs for x in r.ids) == sorted((r.k or "", r.id if r.id is not None else -1) for r in df.collect())
    assert 4 <= sum(r.k == "z" for r in packs) <= 5


def test_walks_along_chains_send_no_step_to_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    links = spark.range(40).selectExpr("id AS node", "IF(id % 10 = 9, id - 9, id + 1) AS next").where("node <> 19")
    ends = {r.node: (r.end, r.depth) for r in graph.chain_ends(links).collect()}
    assert ends[10] == (19, 9) and ends[25] == (None, None) and len(ends) == 39
    at = {r.node: r.position for r in graph.positions(links, spark.createDataFrame([(10,), (33,)], "node long")).collect()}
    assert at[19] == 9 and at[32] == 9 and len(at) == 20
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_a_bounded_walk_takes_rounds_by_its_bound_and_not_by_the_longest_chain(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(graph, "stored", lambda df: tables.append(df) or stored(df))
    links = spark.range(3000).selectExpr("id AS node", "id + 1 AS next").where("node <> 1004")
    seeds = spark.createDataFrame([(0,), (1000,)], "node long")
    at = {r.node: r.position for r in graph.positions(links, seeds, 10).collect()}
    assert at == {**{k: k for k in range(10)}, **{1000 + k: k for k in range(5)}}
    assert len(tables) <= 2 + 3 * 4


def test_pages_of_labelled_items_are_dealt_by_their_text(spark, monkeypatch):
    pages = spark.range(50).selectExpr("id AS page", "'PARTIDA 3: Entregar planos' AS text")
    assert labelled.structured_blocks(pages, ["page"], "text").rdd.getNumPartitions() <= 4
    monkeypatch.setattr(labelled, "CHARS", 100)
    found = labelled.structured_blocks(pages, ["page"], "text")
    assert found.rdd.getNumPartitions() == 13 and found.where("item = '3'").count() == 50


def test_tables_of_pages_are_dealt_by_page_but_once(spark):
    for name, most in (("ruled_table_rows", 2), ("standing_table_rows", 1)):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert 1 <= plan.count("Exchange") <= most, name


def test_words_of_tables_are_sorted_once_and_never_grouped_by_rows(spark):
    plan = registry.QUERIES["standing_table_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") <= 2


def test_similar_sets_meet_in_parts_and_never_travel_with_a_pair(spark, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(match, "PART", 300)
    monkeypatch.setattr(match, "NUMBERED", 20)
    sets = {k: frozenset(r.sample([f"t{n}" for n in range(60)], r.randint(1, 30))) for k in range(80)}
    sets |= {k + 80: (s | {"u"}) - {min(s)} for k, s in sets.items() if len(s) > 3}
    df = spark.createDataFrame([(k, k % 2 or None, sorted(v)) for k, v in sets.items()], "id long, b long, w array<string>")
    for block in ((), ("b",)):
        first = {}
        for k, v in sorted(sets.items()):
            first.setdefault((v, block and k % 2), k)
        reps = sorted(first.values())
        want = {(a, b) for a in reps for b in reps if a < b and not (block and (a - b) % 2) and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
        monkeypatch.setattr(match, "STEP", 40)
        found = match.jaccard_pairs(match.token_classes(df, "id", "w", block), 0.5)
        assert sorted((x.a, x.b) for x in found.collect()) == sorted(want)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_near_exact_texts_meet_by_whole_chunks_and_none_is_lost(spark, monkeypatch):
    r, texts = random.Random(5), []
    for n in (9, 10, 14, 20, 33, 60, 120, 250):
        for _ in range(6):
            base = "".join(r.choice("aábc eñ\U0001f600") for _ in range(n))
            texts.append(base)
            for most in (1, 2, n // 25 + 1, n // 12):
                t = list(base)
                for _ in range(r.randint(1, max(most, 1))):
                    k = r.randrange(len(t))
                    t[k : k + r.randint(0, 1)] = r.choice(["", "x", "a"])
                texts.append("".join(t))
    texts = sorted(set(texts))
    want = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if a < b and abs(len(x) - len(y)) < 20 and max(difflib.SequenceMatcher(None, *p).ratio() for p in ((x, y), (y, x))) >= 0.95}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    monkeypatch.setattr(match, "PART", 2_000)
    monkeypatch.setattr(match, "STEP", 500)
    found = {(p.a, p.b) for p in match.near_texts(df, "id", "t", 0.95).collect()}
    assert len(want) > 40 and want <= found and len(found) < len(texts) ** 2 / 20


def test_texts_on_one_annex_and_action_are_one_whatever_else_they_say(spark):
    texts = [(1, "Anexo A: presentar carta garantia firme"), (2, "presentar segun el anexo A carta garantia, planos, muestras, calendario detallado y memoria descriptiva"), (3, "presentar el anexo B con carta garantia")]
    pairs, _ = equivalence.judged_pairs(spark.createDataFrame(texts, "i long, t string"), "i", F.col("t"))
    assert {(p.a, p.b): p.verdict for p in pairs.collect()}.get((1, 2)) == "same_annex_action_signature"


def test_readings_are_compared_in_one_aggregation_without_distinct_rows(spark):
    found = registry.QUERIES["identifier_comparison"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan


def test_texts_of_offered_spans_are_dealt_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(discovery, "CHARS", 100)
    pages = spark.range(50).selectExpr("id", "'Se modifica el Anexo 3. Otra cosa sin nada.' AS text").coalesce(1)
    found = discovery.offered_spans(pages, ["id"], "text")
    assert found.count() == 100 and "hashpartitioning(id" in found._jdf.queryExecution().toString() and found.rdd.getNumPartitions() > 8


def test_parts_of_requirement_spans_are_dealt_to_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(requirements, "PARTS", 10)
    spark.range(200).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert registry.QUERIES["requirement_spans"](spark, str(tmp_path)).rdd.getNumPartitions() == 20


def test_equivalent_pairs_travel_with_texts_and_guards_but_without_their_words(spark, monkeypatch):
    """Pairs that merely share words are no candidates, and word sets of candidates stay behind."""
    beside, seen = equivalence.beside_each_other, []
    monkeypatch.setattr(equivalence, "beside_each_other", lambda *given: seen.append(beside(*given)) or seen[-1])
    texts = [(k, f"bomba valvula {k} brida tubo{'x' * k} codo{'y' * (k % 3)}") for k in range(12)] + [(20, "bomba valvula brida tubo nuevo"), (21, "bomba valvula brida tubo nuevos")]
    pairs, _ = equivalence.same_pairs(spark.createDataFrame(texts, "i long, t string"), "i", F.col("t"))
    assert [(p.a, p.b, p.verdict) for p in pairs.collect()] == [(20, 21, "near_exact_lexical_match")]
    assert not {"tokens", "content"} & set(seen[0].schema["x"].dataType.names) and seen[0].count() < 20


def test_sets_that_share_most_tokens_are_compared_by_products_and_none_is_lost(spark, monkeypatch):
    """Few tokens that all sets share: all signatures of allowed sizes are compared, with the pairs that brute force finds."""
    r = random.Random(8)
    monkeypatch.setattr(match, "STEP", 900)
    sets = sorted({frozenset(r.sample(range(30), r.randint(8, 25))) for _ in range(150)}, key=sorted)
    df = spark.createDataFrame([(k, [f"t{n}" for n in sorted(s)]) for k, s in enumerate(sets)], "id long, w array<string>")
    for meeting in (0, 10**9):
        monkeypatch.setattr(match, "MEETING", meeting)
        for least in (0.5, 0.8):
            want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and len(x & y) >= least * len(x | y)}
            found = [(x.a, x.b) for x in match.jaccard_pairs(match.token_classes(df, "id", "w"), least).collect()]
            assert len(found) == len(want) and set(found) == want
