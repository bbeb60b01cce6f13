"""Operators on tiny frames: nulls, ties, cycles, zeros and the like."""

import difflib
import uuid

from pyspark.sql import functions as F

import pytest
from ledgerloom.functions import evaluation, money, tender
from ledgerloom.functions import text as X
from ledgerloom.operators import chunks, diff, effects, equivalence, graph, match, paging, readiness, rollup, state


def test_upsert_keeps_history(spark):
    old = spark.createDataFrame([("a", "1", 5, None, 1), ("b", "1", 6, None, 3), (None, "1", 7, None, 1)], "k string, fp string, v int, previous_fingerprint string, revision long")
    new = spark.createDataFrame([("a", "1", 50), ("b", "2", 60), ("c", "9", 1), (None, "1", 8)], "k string, fp string, v int")
    got = {r.k: tuple(r)[1:] for r in state.upsert(old, new, ["k"], "fp", ["v"]).collect()}
    assert got == {"a": (50, "1", None, 1, "UNCHANGED"), "b": (60, "2", "1", 4, "UPDATED"), "c": (1, "9", None, 1, "INSERTED"), None: (8, "1", None, 1, "UNCHANGED")}


def test_upsert_takes_null_fingerprints_and_repeated_keys(spark):
    old = spark.createDataFrame([("a", "1", 5, None, 1), ("b", None, 6, None, 2)], "k string, fp string, v int, previous_fingerprint string, revision long")
    new = spark.createDataFrame([("a", None, 77), ("b", None, 60), ("c", None, 9), ("d", "1", 1), ("d", "2", 2)], "k string, fp string, v int")
    got = {r.k: tuple(r)[1:] for r in state.upsert(old, new, ["k"], "fp", ["v"]).collect()}
    assert got == {"a": (77, None, "1", 2, "UPDATED"), "b": (60, None, None, 2, "UNCHANGED"), "c": (9, None, None, 1, "INSERTED"), "d": (2, "2", None, 1, "INSERTED")}
    ordered = state.upsert(old, spark.createDataFrame([("d", "2", 2, 1), ("d", "1", 1, 2)], "k string, fp string, v int, at int"), ["k"], "fp", ["v"], order=("at",))
    assert [(r.v, r.fp) for r in ordered.collect() if r.k == "d"] == [(1, "1")]


def test_append_missing_knows_null_keys(spark):
    log = spark.createDataFrame([("a",), (None,)], "k string")
    batch = spark.createDataFrame([("a", 1), (None, 2), ("b", 4), ("b", 3)], "k string, v int")
    assert [tuple(r) for r in state.append_missing(log, batch, "k").collect()] == [("b", 3)]
    assert [tuple(r) for r in state.append_missing(log.where("k = 'a'"), batch.where("k IS NULL"), "k").collect()] == [(None, 2)]


def test_jaccard_with_empty_sets_blocks_of_any_name_and_equal_sets(spark):
    rows = [(1, "x", ["p", "q", "r", "s"]), (2, "x", ["p", "q", "r"]), (3, "x", ["q", "p", "s", "r", "p"]), (4, "x", []), (5, "x", None), (6, "y", ["p", "q", "r"]), (7, None, ["z", "w"]), (8, None, ["z"])]
    df = spark.createDataFrame(rows, "id int, a string, w array<string>").withColumn("b", F.lit(1))
    classes = match.token_classes(df, "id", "w", ("a", "b"))
    assert sorted((r["__id"], r["__class"]) for r in classes.collect()) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8)]
    assert sorted(tuple(r) for r in match.jaccard_pairs(classes, 0.5).collect()) == [(1, 2, 0.75), (7, 8, 0.5)]


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_jaccard_pairs_lose_none(spark, least):
    import random

    r = random.Random(7)
    sets = {k: frozenset(f"t{int(r.paretovariate(0.7))}" for _ in range(r.randint(1, 12))) for k in range(120)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id int, w array<string>")
    first = {}
    for k, v in sets.items():
        first.setdefault(v, k)
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
    assert {(x.a, x.b) for x in match.jaccard_pairs(match.token_classes(df, "id", "w"), least).collect()} == want


def test_places_of_all_rows(spark):
    rows = [(k * 37 % 1000, k) for k in range(1000)] + [(None, 2000)]
    got = paging.ranked(spark.createDataFrame(rows, "a int, b int").repartition(4), [F.asc_nulls_last("a"), F.col("b")]).collect()
    want = {b: k + 1 for k, (_, b) in enumerate(sorted(rows, key=lambda t: (t[0] is None, t[0], t[1])))}
    assert {r.b: r.place for r in got} == want


def test_absence_needs_a_complete_scan(spark):
    known = spark.createDataFrame([(1, True), (2, True), (3, False)], "k int, present boolean")
    scan = spark.createDataFrame([(1,), (3,)], "k int")
    assert {tuple(r) for r in diff.absence(known, scan, "k", "present", True).collect()} == {(2, "NO_LONGER_OBSERVED"), (3, "REAPPEARED")}
    assert [tuple(r) for r in diff.absence(known, scan, "k", "present", False).collect()] == [(3, "REAPPEARED")]


def test_runs_of_an_item_are_found_wherever_they_stand(spark):
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "x C, d e"), (3, "b c y d e"), (4, "z Q r"), (5, None), (6, "q z r")], "d int, t string")
    items = spark.createDataFrame([(10, "a b c d e"), (11, "q r"), (12, "")], "i int, t string")
    got = match.holds_run(docs, "d", "t", items, "i", "t", 3)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10), (2, 10), (4, 11)]


def test_chains_and_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (12, 10), (20, 20)], "node long, next long")
    got = {r.node: (r.end, r.depth) for r in graph.chain_ends(links).collect()}
    assert got == {1: (4, 3), 2: (4, 2), 3: (4, 1), 10: (None, None), 11: (None, None), 12: (None, None), 20: (None, None)}


def test_long_chains_end(spark):
    links = spark.range(3000).selectExpr("id AS node", "id + 1 AS next").unionByName(spark.createDataFrame([(9000, 9001), (9001, 9000)], "node long, next long"))
    got = {r.node: (r.end, r.depth) for r in graph.chain_ends(links).collect()}
    assert got == {**{k: (3000, 3000 - k) for k in range(3000)}, 9000: (None, None), 9001: (None, None)}


EFFECT_CASES = {
    "none": ([], {1: ("ACTIVE", None, None)}),
    "one superseder": ([(2, 1, "SUPERSEDES", "DOCUMENT_WIDE", False)], {1: ("SUPERSEDED", None, 2), 2: ("ACTIVE", None, None)}),
    "chain": ([(2, 1, "SUPERSEDES", "DOCUMENT_WIDE", False), (3, 2, "SUPERSEDES", "DOCUMENT_WIDE", False)], {1: ("SUPERSEDED", None, 3), 2: ("SUPERSEDED", None, 3)}),
    "revoked": ([(2, 1, "REVOKES", "DOCUMENT_WIDE", False)], {1: ("REVOKED", None, None)}),
    "no revival": ([(2, 1, "SUPERSEDES", "DOCUMENT_WIDE", False), (3, 2, "REVOKES", "DOCUMENT_WIDE", False)], {1: ("REVIEW_REQUIRED", "NO_REVIVAL_REQUIRES_REVIEW", None), 2: ("REVOKED", None, None)}),
    "ring": ([(2, 1, "SUPERSEDES", "DOCUMENT_WIDE", False), (1, 2, "SUPERSEDES", "DOCUMENT_WIDE", False)], {1: ("REVIEW_REQUIRED", "SUPERSESSION_CYCLE", None), 2: ("REVIEW_REQUIRED", "SUPERSESSION_CYCLE", None)}),
    "two superseders": ([(2, 1, "SUPERSEDES", "DOCUMENT_WIDE", False), (3, 1, "SUPERSEDES", "DOCUMENT_WIDE", False)], {1: ("REVIEW_REQUIRED", "MULTIPLE_SUPERSEDING_SOURCES", None)}),
    "both ends": ([(2, 1, "SUPERSEDES", "DOCUMENT_WIDE", False), (3, 1, "REVOKES", "DOCUMENT_WIDE", False)], {1: ("REVIEW_REQUIRED", "CONFLICTING_TERMINAL_EFFECTS", None)}),
    "self": ([(1, 1, "AMENDS", "DOCUMENT_WIDE", False)], {1: ("REVIEW_REQUIRED", "SELF_SOURCE_EFFECT", None)}),
    "unknown actor": ([(99, 1, "REVOKES", "DOCUMENT_WIDE", False)], {1: ("ACTIVE", None, None)}),
    "under review": ([(2, 1, "REVOKES", "DOCUMENT_WIDE", True)], {1: ("REVIEW_REQUIRED", "REVIEW_REQUIRED_EFFECT_TARGET_BLOCKS_AUTOMATION", None)}),
    "open scope": ([(2, 1, "REVOKES", "UNRESOLVED", False)], {1: ("REVIEW_REQUIRED", "UNRESOLVED_SCOPE_TARGET_BLOCKS_AUTOMATION", None)}),
    "partial": ([(2, 1, "SUPERSEDES", "PARTIAL", False)], {1: ("ACTIVE_WITH_EFFECTS", None, None)}),
    "amended": ([(2, 1, "AMENDS", "DOCUMENT_WIDE", False)], {1: ("ACTIVE_WITH_EFFECTS", None, None)}),
    "amended by a superseded one": (
        [(2, 1, "AMENDS", "DOCUMENT_WIDE", False), (3, 2, "SUPERSEDES", "DOCUMENT_WIDE", False)],
        {1: ("REVIEW_REQUIRED", "ACTING_SOURCE_SUPERSEDED_MIXED_EFFECT_REQUIRES_REVIEW", None), 2: ("SUPERSEDED", None, 3)},
    ),
    "amended by a revoked one": ([(2, 1, "CLARIFIES", "PARTIAL", False), (3, 2, "REVOKES", "DOCUMENT_WIDE", False)], {1: ("REVIEW_REQUIRED", "REVOKED_ACTING_SOURCE_EFFECT_APPLICABILITY_UNRESOLVED", None)}),
    "superseder under review": (
        [(2, 1, "SUPERSEDES", "DOCUMENT_WIDE", False), (3, 2, "SUPERSEDES", "DOCUMENT_WIDE", False), (4, 3, "AMENDS", "DOCUMENT_WIDE", True)],
        {1: ("REVIEW_REQUIRED", "SUPERSEDING_SOURCE_REVIEW_REQUIRED", None), 2: ("REVIEW_REQUIRED", "SUPERSEDING_SOURCE_REVIEW_REQUIRED", None), 3: ("REVIEW_REQUIRED", "REVIEW_REQUIRED_EFFECT_TARGET_BLOCKS_AUTOMATION", None)},
    ),
}


def test_effects_case_by_case(spark):
    """Each case in a range of ids of its own, all resolved together."""
    rows, want, at = [], {}, 0
    for edges, told in EFFECT_CASES.values():
        rows += [(a + at if a != 99 else -1, t + at, *rest) for a, t, *rest in edges]
        want |= {k + at: (s, why, None if r is None else r + at) for k, (s, why, r) in told.items()}
        at += 10
    edges = spark.createDataFrame(rows, "actor long, target long, kind string, scope string, review boolean")
    got = {r.document: (r.status, r.reason, r.replacement) for r in effects.resolve_documents(edges, spark.range(1, at).withColumnRenamed("id", "document")).collect()}
    assert {k: got[k] for k in want} == want


def test_places_fail_closed(spark):
    docs = spark.createDataFrame([(k, s) for k, s in ((1, "ACTIVE"), (2, "ACTIVE"), (3, "REVOKED"), (4, "ACTIVE"))], "document long, status string")
    rows = [(2, 1, "SUPERSEDES", "a"), (2, 1, "SUPERSEDES", "b"), (4, 1, "SUPERSEDES", "B "), (2, 1, "REVOKES", "c"), (2, 1, "AMENDS", "d"), (4, 1, "CORRECTS", "d"), (2, 1, "CLARIFIES", "e"), (3, 1, "AMENDS", "f"), (2, 1, "REVOKES", "g"), (4, 1, "SUPERSEDES", "g"), (2, 1, "UNSPECIFIED", "h"), (2, 77, "AMENDS", "a"), (2, 1, "AMENDS", None)]
    e = spark.createDataFrame([(*r, "PARTIAL", False) for r in rows] + [(2, 1, "AMENDS", "i", "PARTIAL", True), (2, 1, "AMENDS", "z", "DOCUMENT_WIDE", False)], "actor long, target long, kind string, locator string, scope string, review boolean")
    got = {r.place: (r.status, r.source) for r in effects.resolve_places(e, docs, X.locator_identity(F.col("locator"))).collect()}
    review = ("REVIEW_REQUIRED", None)
    assert got == {"a": ("SUPERSEDED", 2), "b": review, "c": ("REVOKED", None), "d": ("MODIFIED", None), "e": ("CLARIFIED", None), "f": review, "g": review, "h": ("UNCHANGED", None), "i": review}


def test_scans_of_documents(spark):
    known = spark.createDataFrame([(1, "a", "x", True), (1, "b", "x", True), (1, "c", "x", False), (2, "a", "x", True)], "k int, d string, fp string, active boolean")
    scan = spark.createDataFrame([(1, "a", "y"), (1, "c", "x"), (1, "e", "x")], "k int, d string, fp string")
    whole = {tuple(r) for r in diff.document_events(known, scan, ["k", "d"], "fp", "active", True).collect()}
    assert whole == {(1, "a", "DOCUMENT_CHANGED"), (1, "b", "DOCUMENT_REMOVED"), (1, "c", "DOCUMENT_ADDED"), (1, "e", "DOCUMENT_ADDED")}
    assert {tuple(r) for r in diff.document_events(known, scan, ["k", "d"], "fp", "active", False).collect()} == whole - {(1, "b", "DOCUMENT_REMOVED")}


def test_effects_fail_closed(spark):
    docs = spark.createDataFrame([(i,) for i in range(1, 9)], "document long")
    edges = [(1, 2, "SUPERSEDES", False), (1, 3, "SUPERSEDES", False), (4, 3, "SUPERSEDES", False), (4, 5, "REVOKES", False), (1, 6, "SUPERSEDES", True), (7, 7, "SUPERSEDES", False), (99, 8, "REVOKES", False), (1, 2, "SUPERSEDES", False)]
    got = {r.document: (r.status, r.replacement) for r in graph.effects(spark.createDataFrame(edges, "actor long, target long, kind string, review boolean"), docs).collect()}
    review = ("REVIEW_REQUIRED", None)
    assert got == {1: ("EFFECTIVE", None), 2: ("SUPERSEDED", 1), 3: review, 4: ("EFFECTIVE", None), 5: ("REVOKED", None), 6: review, 7: review, 8: review}


def test_precedence(spark):
    rows = [("one", None, None, "x"), ("later", "2024-01-01", None, "a"), ("later", "2024-01-02", None, "b"), ("day", "2024-01-01", None, "a"), ("day", "2024-01-01", "10:00", "b")]
    rows += [("time", "2024-01-01", "09:00", "a"), ("time", "2024-01-01", "10:00", "b"), ("tie", "2024-01-01", "10:00", "a"), ("tie", "2024-01-01", "10:00", "b"), ("undated", "2024-01-01", "10:00", "a"), ("undated", None, None, "b")]
    got = {r.k: r.value for r in graph.precedence(spark.createDataFrame(rows, "k string, day string, t string, v string"), "k", "day", "t", "v").collect()}
    assert got == {"one": "x", "later": "b", "day": None, "time": "b", "tie": None, "undated": None}


def test_prices(spark):
    rows = [(1.005, 2.0, 3.0, "EUR"), (0.0, 1.0, 1.0, "EUR"), (2.0, 0.0, 1.0, "EUR"), (None, 1.0, 1.0, None), (10.0, 8.0, 0.0, "EUR")]
    c, p, q, cur = F.col("c").cast("decimal(24,6)"), F.col("p").cast("decimal(24,6)"), F.col("q").cast("decimal(12,4)"), F.col("cur")
    df = spark.createDataFrame(rows, "c double, p double, q double, cur string")
    codes = money.warnings(c, p, q, cur)
    got = df.select(money.total(c, q, cur).cast("double").alias("t"), money.markup(c, p).cast("double").alias("u"), money.margin(c, p).cast("double").alias("g"), codes.alias("w"), money.line_status(codes).alias("s")).collect()
    assert [r.t for r in got] == [3.02, 0.0, 2.0, None, 0.0]
    assert (got[0].u, got[1].u, got[2].g) == (99.00497512, None, None)
    assert [r.w for r in got] == [[], ["ZERO_COST"], ["ZERO_PRICE", "PRICE_BELOW_COST"], ["MISSING_CURRENCY", "COST_UNRESOLVED"], ["PRICE_BELOW_COST"]]
    assert [r.s for r in got] == ["READY", "READY", "READY", "INCOMPLETE", "READY"]
    targets = spark.createDataFrame([("MARKUP", 50.0), ("MARGIN", 50.0), ("MARGIN", 100.0), ("MARKUP", -101.0)], "b string, t double")
    assert [float(r[0]) if r[0] is not None else None for r in targets.select(money.recommended(F.lit(10), F.col("b"), F.col("t"))).collect()] == [15.0, 20.0, None, None]


def test_what_is_wrong_with_a_price(spark):
    """(cost, price, mode, basis, target, currency) -> codes; a missing cost is advice, a bad target only blocks without a price."""
    cases = [
        ((None, "5", "PRICE_FIRST", None, None, "MXN"), ["COST_UNRESOLVED"], "READY"),
        (("-1", "5", "PRICE_FIRST", None, None, "MXN"), ["NEGATIVE_VALUE"], "REVIEW_REQUIRED"),
        (("5", None, "PRICE_FIRST", None, None, "MXN"), ["MISSING_OFFERED_PRICE"], "INCOMPLETE"),
        (("5", "6", "COST_FIRST", "MARGIN", "100", "MXN"), ["INVALID_MARGIN"], "READY"),
        (("5", None, "COST_FIRST", "MARKUP", "-101", "MXN"), ["MISSING_OFFERED_PRICE", "INVALID_MARKUP"], "INCOMPLETE"),
        (("5", "6", "COST_FIRST", None, "10", "MXN"), ["MISSING_CALCULATION_BASIS"], "READY"),
        (("900000000000000000", "6", "COST_FIRST", "MARKUP", "100", "MXN"), ["PRICE_BELOW_COST", "CALCULATION_OUT_OF_RANGE"], "READY"),
        (("5", "6", "COST_FIRST", "MARKUP", "100", None), ["MISSING_CURRENCY"], "INCOMPLETE"),
    ]
    df = spark.createDataFrame([(k, *c) for k, (c, _, _) in enumerate(cases)], "i int, c string, p string, mode string, basis string, t string, cur string")
    c, p, t = F.col("c").cast("decimal(24,6)"), F.col("p").cast("decimal(24,6)"), F.col("t").cast("decimal(18,8)")
    codes = money.warnings(c, p, F.lit(1), F.col("cur"), F.col("mode"), F.col("basis"), t)
    got = df.select("i", codes.alias("w"), money.line_status(codes, p, F.col("mode")).alias("s"), money.recommended(c, F.col("basis"), t, F.col("cur")).alias("r")).orderBy("i").collect()
    assert [(r.w, r.s) for r in got] == [(w, s) for _, w, s in cases] and got[7].r is None
    needed = df.where("i = 0").select(money.severity(F.lit("COST_UNRESOLVED"), p, F.lit("COST_FIRST"), manual=False).alias("s")).first().s
    assert needed == "BLOCKER"


def test_events_need_their_wording(spark):
    texts = ["fallo", "fecha del fallo", "firma del contrato", "firma del contrato y plazo de ejecucion", "se publica la adenda 2", "cancelada", "evaluacion tecnicamente", "fecha limite para presentar proposiciones"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string")
    got = [r.e for r in df.select("i", tender.events(F.col("t")).alias("e")).orderBy("i").collect()]
    assert got == [[], ["AWARD_ANNOUNCEMENT"], ["CONTRACT_SIGNATURE_DEADLINE"], [], ["ADDENDUM_PUBLICATION"], ["CANCELLATION"], [], ["PROPOSAL_SUBMISSION_DEADLINE"]]


def test_weights_stand_in_their_context(spark):
    far = "x" * 150
    texts = ["ponderacion 60 % y 40,5 %", "fianza del 10 %", f"ponderacion 60 % {far} pena convencional 5 %", f"ponderacion {far} 5 %", "metodologia del adjudicatario 10 %", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string")
    got = [r.w for r in df.select("i", evaluation.weights(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got == [[60.0, 40.5], [], [60.0], [], [], []]


def test_text_rules(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column.alias("x")).first().x

    assert value(X.tidy_lines(F.lit("a  \r\n\r\n\r\n\r\nb\x07\n"))) == "a\n\nb"
    assert value(X.tidy_lines(F.lit("e\u0301\tx\u200b \u00a0\r y\ue000"))) == "éx\n y"
    assert value(X.tidy_lines(F.lit(None).cast("string"))) == ""
    assert value(X.folded(F.lit("  Straße ÉCOLE\n"))) == "strasse ecole"
    assert [value(X.item_number(F.lit(s))) for s in ("01.2.", "1", "0.00", "1..2", "a")] == ["1.2", "1", "0.0", None, None]
    assert value(X.name_uuid("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.lit("x/y"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "x/y"))
    assert value(X.has_term(F.lit("Éplc plc."), "PLC")) and not value(X.has_term(F.lit("éplc"), "plc"))
    assert [value(X.csv_safe(F.lit(s))) for s in ("=1", " @x", "a=1", "\tx", "\rx", "-5", "")] == ["'=1", " @x", "a=1", "'\tx", "'\rx", "'-5", ""]
    assert [value(X.csv_safe(F.lit(s), numeric=True)) for s in ("-5", "+1.5e3", "-x")] == ["-5", "+1.5e3", "'-x"]
    for s, day, kind in (("3 de marzo de 2024", "2024-03-03", "DAY"), ("31/02/2024", None, "UNKNOWN"), ("en MARZO 2023", "2023-03-01", "MONTH"), ("año 2022", "2022-01-01", "YEAR"), ("nada", None, "UNKNOWN")):
        d, k = X.spanish_date(F.lit(s))
        assert (value(d.cast("string")), value(k)) == (day, kind)
    for t, want in (("Bomba (12.5  pzas.). ", ("12.5", "pzas.", "COUNT")), ("(3 m2)", ("3", "m2", "AREA")), ("(x) (7 cajas)", ("7", "cajas", None)), ("(7 piezas) más", (None, None, None)), ("(12,5 kg)", (None, None, None)), ("(7)", (None, None, None))):
        amount, unit = X.terminal_quantity(F.lit(t))
        assert (value(amount), value(unit), value(X.measure_kind(unit))) == want


def test_chunks_cover_and_overlap():
    text = ("word " * 900).strip()
    spans = list(chunks.cuts(text))
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and list(chunks.cuts("")) == []
    assert all(b - a <= 1800 for a, b in spans) and all(x[1] - y[0] == 200 for x, y in zip(spans, spans[1:], strict=False))
    assert all(text[b - 1] == " " for _, b in spans[:-1])
    assert list(chunks.cuts("x" * 1800)) == [(0, 1800)] and list(chunks.cuts("x" * 2000)) == [(0, 1800), (1600, 2000)]
    assert list(chunks.cuts("ab " + "x" * 1900))[0] == (0, 3) and list(chunks.cuts("a" + " " * 1799 + "b"))[0] == (0, 1800)


def test_nearest_within_bound_and_ties(spark):
    a = spark.createDataFrame([("k", 100, 1), ("k", 999, 2)], "k string, at long, id long")
    b = spark.createDataFrame([("k", 90, 8), ("k", 110, 7), ("j", 100, 6), ("k", 1010, 9)], "k string, at long, id long")
    assert [tuple(r) for r in match.nearest_within(a, b, "k", "at", "id", 10).collect()] == [(1, 7, 10)]


def test_lattices(spark):
    df = spark.createDataFrame([("a", "READY"), ("a", "REVIEW_REQUIRED"), ("b", "NOT_APPLICABLE"), ("c", None), ("d", "what")], "k string, s string")
    got = {r.k: r.w for r in df.groupBy("k").agg(rollup.worst_status(F.col("s")).alias("w")).collect()}
    assert got == {"a": "REVIEW_REQUIRED", "b": "NOT_APPLICABLE", "c": "BLOCKED", "d": "BLOCKED"}


def test_adjudication_without_judgments(spark):
    df = spark.createDataFrame([("a", "T", "x"), ("a", "F", "y"), ("b", None, None)], "d string, j string, t string")
    got = {r.d: (r.precision, r.recall) for r in readiness.adjudicate(df, "d", "j", "t", ("T",)).collect()}
    assert got == {"a": (0.5, 0.5), "b": (None, None)}


def test_equivalence_verdicts_and_groups(spark):
    texts = [
        (1, "Presentar el Anexo A con la carta del fabricante"), (2, "Anexar y presentar el anexo A, carta del fabricante de la bomba nueva"), (3, "Presentar el Anexo B con la carta del fabricante"),
        (4, "El licitante entregará 10 bombas centrífugas de acero"), (5, "El licitante entregará 12 bombas centrífugas de acero"), (6, "El licitante entregará 10 bombas centrifugas de acero"),
        (7, "El consorcio entregará 10 bombas centrífugas de acero"), (8, "Se entregan bombas centrífugas de acero inoxidable para agua limpia original"), (9, "Se entregan bombas centrífugas de acero inoxidable para agua limpia"),
        (10, "Se entregan bombas centrifugas de acero inoxidable para aguas limpias"), (11, "limpia agua para inoxidable acero de centrífugas bombas entregan Se"), (12, None), (13, ""),
    ]
    df = spark.createDataFrame(texts, "i long, t string")
    pairs, members = equivalence.judged_pairs(df, "i", F.col("t"), 0.4)
    got = {(r.a, r.b): r.verdict for r in pairs.collect()}
    assert got[1, 3] == "annex_mismatch" and got[1, 2] == "same_annex_action_signature"
    assert got[4, 5] == "numeric_mismatch" and (4, 6) not in got and got[4, 7] == "actor_scope_mismatch"
    assert got[8, 9] == "qualifier_mismatch" and got[9, 10] == "near_exact_lexical_match" and got[9, 11] == "insufficient_similarity"
    assert dict(map(tuple, members.collect()))[6] == 4
    told = dict(map(tuple, equivalence.groups(pairs, members).collect()))
    assert told == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 4, 7: 7, 8: 8, 9: 9, 10: 9, 11: 11}


def test_groups_are_complete_links(spark):
    """1 is one with 2 and 2 with 3, but 1 not with 3; 4 is one with all."""
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (2, 4), (3, 4), (5, 6)], "a long, b long").withColumn("verdict", F.lit("near_exact_lexical_match"))
    members = spark.createDataFrame([(k, k) for k in range(1, 8)] + [(70, 7)], "id long, class long")
    got = dict(map(tuple, equivalence.groups(pairs, members).collect()))
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5, 7: 7, 70: 7}


def test_chain_ends_keep_small_estimates_over_many_rounds(spark):
    """A path of 3,000 links (12 rounds), a cycle with a tail, a short chain: ends, depths, and a plan whose size estimate stays a number of bytes."""
    links = [(k, k + 1) for k in range(3000)] + [(10_000, 10_001), (10_001, 10_002), (10_002, 10_001)] + [(20_000, 20_001)]
    ends = graph.chain_ends(spark.createDataFrame(links, "node long, next long"))
    got = {r.node: (r.end, r.depth) for r in ends.collect()}
    assert got == {**{k: (3000, 3000 - k) for k in range(3000)}, 10_000: (None, None), 10_001: (None, None), 10_002: (None, None), 20_000: (20_001, 1)}
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length()
    assert size(ends) < 64
    twice = graph.chain_ends(ends.where("end IS NOT NULL").selectExpr("node", "end AS next"))
    assert size(twice) < 64


def test_positions_behind_seeds(spark):
    links = [("a", k, k + 1) for k in range(100)] + [("b", 0, 1), ("b", 1, 2), ("b", 2, 0), ("c", 5, None)]
    df = spark.createDataFrame(links, "g string, node long, next long").selectExpr("struct(g, node) AS node", "CASE WHEN next IS NOT NULL THEN struct(g, next AS node) END AS next")
    seeds = spark.createDataFrame([("a", 40), ("b", 1), ("c", 5), ("d", 1)], "g string, node long").selectExpr("struct(g, node) AS node")
    got = {(r.node.g, r.node.node): r.position for r in graph.positions(df, seeds).collect()}
    assert got == {**{("a", 40 + k): k for k in range(61)}, ("b", 1): 0, ("b", 2): 1, ("b", 0): 2, ("c", 5): 0, ("d", 1): 0}


def test_near_exact_texts_of_few_long_words_meet(spark):
    texts = [(1, "constitucionalidad internacionalizaciones desproporcionadamente"), (2, "constitucionalidat internacionalizaciones desproporcionadamente"), (3, "constitucionalidat internacionalizacionez desproporcionadamente"), (4, "abcd"), (5, "abce"), (6, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (8, "xy"), (9, None)]
    pairs, _ = equivalence.judged_pairs(spark.createDataFrame(texts, "i int, t string"), "i", F.col("t"))
    told = {(r.a, r.b): r.verdict for r in pairs.collect()}
    assert {k for k, v in told.items() if v == "near_exact_lexical_match"} == {(1, 2), (2, 3), (1, 3), (6, 7)}


def test_pairs_of_texts_whose_words_are_a_class_are_not_left_out(spark):
    """2 and 3 have one set of words, so 3 stands behind 2; 4 and 5 share content, but no other words; 6 and 7 have no content at all."""
    far = "valvulas tuberias bridas empaques tornilleria soportes"
    texts = [
        (1, f"se entregan bombas centrifugas de acero {far}"), (2, f"{far} acero de centrifugas bombas entregan se"), (3, f"{far} acero de centrifugas bombas entregan nuevas"), (8, f"acero {far} de centrifugas bombas entregan se"),
        (4, "a documentacion b suministro c instalacion d capacitacion e mantenimiento f garantia g"), (5, "h documentacion i suministro j instalacion k capacitacion l mantenimiento m garantia n"), (6, "a b c d e f g h i j"), (7, "a b c d e f g h j i"),
        (9, "zz a b c d e f g h i j k l m n"), (10, "zz a b c d e f g h i j k l n m"),
    ]
    df = spark.createDataFrame(texts, "i long, t string")
    told = {(r.a, r.b): r.verdict for r in equivalence.judged_pairs(df, "i", F.col("t"))[0].collect()}
    same = {k for k, v in told.items() if v in equivalence.SAME}
    rows = [(i, set(w for w in t.split() if len(w) > 2 and w not in equivalence.STOPWORDS), t) for i, t in texts]
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    overlap = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
    want = {(i, j) for i, x, s in rows for j, y, t in rows if i < j and (ratio(s, t) >= 0.95 or (ratio(s, t) >= 0.88 and overlap(x, y) >= 0.7))}
    assert {(2, 3), (4, 5), (6, 7)} <= want and same == want and (2, 8) in told and (3, 8) in told
    assert {(r.a, r.b) for r in equivalence.same_pairs(df, "i", F.col("t"))[0].collect()} == want
