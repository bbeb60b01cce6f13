"""Vector codes, spelling variants and language-model scores against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Row

from ledgerloom.llm import attention, lm, spelling, vacodes
from ledgerloom.llm import queries as Q

# ---- vector codes


def plain_codes(rows, s):
    """(code, error) of each row, and all entries; rows: (id, vector) in order of ids."""
    q = [[math.floor(s.scale * x) if abs(x) < 2**900 else int(x) * s.scale for x in v] for _, v in rows]
    width = len(q[0])
    spans = vacodes.cuts(width, s.parts)
    books = [[v[a:b] for v in q[: s.entries]] for a, b in spans]

    def best(p, piece):
        gaps = [sum((x - y) ** 2 for x, y in zip(piece, e, strict=True)) for e in books[p]]
        return min(range(len(gaps)), key=lambda k: (gaps[k], k)), min(gaps)

    for _ in range(s.rounds):
        for p, (a, b) in enumerate(spans):
            to = {}
            for v in q:
                to.setdefault(best(p, v[a:b])[0], []).append(v[a:b])
            for e, pieces in to.items():
                books[p][e] = [sum(c) // len(pieces) for c in zip(*pieces, strict=True)]
    out = []
    for v in q:
        told = [best(p, v[a:b]) for p, (a, b) in enumerate(spans)]
        out.append(("".join(f"{k:02x}" for k, _ in told), sum(g for _, g in told)))
    return out, books


@pytest.mark.parametrize("huge", [False, True])
def test_codes_equal_comparing_all(spark, huge):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.75, rng.gauss(0, 1)]) * (1e250 if huge and i % 3 == 0 else 1) for _ in range(10)], i % 2 or None) for i in range(40)]
    s = vacodes.Settings(parts=3, entries=5, rounds=3)
    more = [(98, None, 1), (99, [1.0] * 9 + [math.nan], 1), (100, [1.0] * 9 + [None], 1), (101, [math.inf] * 10, 1), (102, [1.0, 2.0], 7)]
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, label=k, error=i, code="clash") for i, v, k in [*rows, *more]], "vec_id long, embedding array<double>, label long, error long, code string")
    got = {r.vec_id: r for r in vacodes.encode(df, settings=s).collect()}
    plain, books = plain_codes([r[:2] for r in rows], s)
    assert set(got) == {*range(40), 102}
    assert got[102].code is None and got[102].error is None
    for (i, _, _), (code, error) in zip(rows, plain, strict=True):
        assert got[i].code == code and got[i].error == (error if error < 1 << 63 else None)
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(text.encode()).hexdigest()}
    if not huge:
        for i, _, k in rows:
            assert got[i].label_error == sum(e for (_, _, m), (_, e) in zip(rows, plain, strict=True) if m == k)


def test_bounds_leave_out_most_and_never_the_nearest():
    rng = np.random.default_rng(1)
    entries, x = rng.integers(-900, 900, (16, 8)), rng.integers(-1000, 1000, (500, 8))
    entries[7] = entries[3]  # a tie
    index, gap, n = vacodes.Cells(entries, 3).nearest(x)
    all_gaps = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (index == all_gaps.argmin(1)).all() and (gap == all_gaps.min(1)).all()
    assert n < 0.7 * all_gaps.size


def test_codes_of_no_few_and_empty_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vacodes.encode(spark.createDataFrame([], kind)).collect() == []
    assert vacodes.encode(spark.createDataFrame([(1, None, 1)], kind)).collect() == []
    few = vacodes.encode(spark.createDataFrame([(2, [0.5] * 8, None), (1, [1.0] * 8, None), (1, [1.0] * 8, None), (None, [0.5] * 8, None)], kind)).collect()
    assert sorted((str(r.vec_id), r.error, r.label_error) for r in few) == [("1", 0, 0), ("1", 0, 0), ("2", 0, 0), ("None", 0, 0)]
    assert [r.code for r in vacodes.encode(spark.createDataFrame([(2, [], 1)], kind)).collect()] == ["00" * 8]


# ---- spelling variants


def plain_variants(docs):
    runs = Counter()
    for doc, text in docs:
        low = (text or "").encode().lower().decode()
        for run in spelling.RUN.findall(low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            runs[run] += 1
    n = {w: k for w, k in runs.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w in n:
        others = [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and near(w, v)]
        top = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = (n[w], len(others), top if top and n[top] >= 2 * n[w] else None)
    roots = {}
    for w in out:
        r = w
        while out[r][2]:
            r = out[r][2]
        roots[w] = r
    return {(w, f, roots[w], k, m, n[f] if f else None) for w, (k, m, f) in out.items()}


def many_words(seed, letters="abé", n=900):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(160)]
    return [(i, " ".join(rng.choice(words) for _ in range(n // 30)) + ". Prefix" + rng.choice("abc") * rng.randint(1, 3)) for i in range(30)]


@pytest.mark.parametrize("crowd", [3, 256])
def test_variants_equal_comparing_all(spark, crowd):
    docs = [*many_words(5), (None, "ABABA ababa Ababa ababb ÉÉÉÉÉ"), (3, None), (4, ""), (3, "ababa aaaaa aaaaaa aaaaaaa"), (3, "ababa aaaaa aaaaaa aaaaaaa"), (5, "aaaaa aaaaaa aaaaaaa")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n")
    got = {tuple(r) for r in spelling.variants(df, settings=replace(spelling.Settings(), crowd=crowd, shard=50)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(docs)
    assert any(f for _, f, *_ in got) and any(m > 3 for *_, m, _ in got)


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), settings=spelling.Settings(ratio=1))


def test_one_edit_at_ends_and_in_repeats():
    assert spelling.one_edit("aaa", "aaaa") and spelling.one_edit("abc", "xabc") and spelling.one_edit("abc", "abcx") and spelling.one_edit("abc", "abd")
    assert not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb") and not spelling.one_edit("abc", "bcab")


def test_very_long_words_and_crowded_halves(spark):
    long = "x" * 3000
    docs = [(1, f"{long} {long} {long} {long}y {long}y {long}y"), (2, " ".join(f"sharedhalf{a}{b}" for a in "abcdefgh" for b in "abcdefgh" for _ in range(3)))]
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), settings=replace(spelling.Settings(), crowd=8)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(docs)


# ---- language-model scores

SHAPE = attention.Shape(groups=4, group=8, shared=3, width=8, hidden=8, window=6, overlap=2)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    shape = replace(SHAPE, layers=2, heads=2)
    m = attention.fresh(shape, np.full(32, 1 / 32), 1)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    at, targets = rng.integers(0, 32, (3, 6)), rng.integers(0, 32, (3, 6))
    targets[1, 4:] = -1
    _, g = attention.gradients(m, at, targets)
    for name in m.weights:
        flat = m.weights[name].reshape(-1)
        k = int(rng.integers(len(flat)))
        if name == "embed":
            k = int(at[0, 0]) * shape.width
        kept, e = flat[k], 1e-5
        flat[k] = kept + e
        up = attention.gradients(m, at, targets)[0]
        flat[k] = kept - e
        down = attention.gradients(m, at, targets)[0]
        flat[k] = kept
        assert g[name].reshape(-1)[k] == pytest.approx((up - down) / (2 * e), abs=2e-5), name


def test_windows_score_each_position_once():
    for n in (1, 5, 6, 7, 8, 9, 30, 31):
        line, seen = np.arange(n + 1), []
        for rows, used in attention.windows_of(line, SHAPE, most=2):
            for row, some in zip(rows, used, strict=True):
                seen += row[1:][some].tolist()
        assert seen == list(range(1, n + 1)), n


def test_chances_of_all_ids_sum_to_one_and_see_no_future():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, 60).astype(float)
    slots = attention.slots_of(counts, 5, SHAPE)
    m = attention.fresh(SHAPE, slots.prior, 3)
    one = lambda ids: next(attention.score(m, iter([(slots.slot[ids], slots.within[ids].sum())])))
    start = [5, 9, 9, 1, 0, 2, 7, 30]
    given = attention.windows_of(np.concatenate(([31], slots.slot[start])), SHAPE)
    before = sum(float(attention.log_chances(m, attention.trunk(m, r[:, :-1])[0][u], r[:, 1:][u].astype(int)).sum()) for r, u in given) / math.log(10) + slots.within[start].sum()
    ended = one(np.array(start))
    end = 10 ** (ended - before)
    rest = 0.0
    for i in range(60):
        line = np.concatenate(([31], slots.slot[[*start, i]]))
        rest += 10 ** (sum(float(attention.log_chances(m, attention.trunk(m, r[:, :-1])[0][u], r[:, 1:][u].astype(int)).sum()) for r, u in attention.windows_of(line, SHAPE)) / math.log(10) + slots.within[[*start, i]].sum() - before)
    assert end + rest == pytest.approx(1, abs=1e-4)


def plain_base(docs):
    told = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in docs if told(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, i is not None and not told(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in docs]


@pytest.mark.parametrize("frequent", [0, 40])
def test_scores_equal_a_plain_base_and_learn_order(spark, frequent):
    import public_tokenizers

    rng = random.Random(4)
    docs = [(i, " ".join(["the red fox", "a blue whale", "One green frog"][rng.randrange(3)] for _ in range(20)) + f" rare{i % 5}") for i in range(80)]
    docs += [(None, "the red fox"), (3, None), (3, ""), (3, "the  red\tfox\n"), (3, "the  red\tfox\n"), (900, "fox red the " * 20), (901, "the red fox " * 20), (902, "unseen " * 3000), (903, "z" * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS score", "2 AS rid")
    s = lm.Settings(shape=SHAPE, steps=300, frequent=frequent)
    got = lm.score_documents(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, settings=s).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[2], r[5])
    for a, b in zip(sorted(got, key=key), sorted(plain_base(docs), key=key), strict=True):
        assert tuple(a)[:5] == b[:5] and a.base_score == pytest.approx(b[5]) and a.score < 0
    by_id = {r.doc_id: r for r in got}
    assert by_id[901].score > by_id[900].score + 20
    again = [r.score for r in got if r.doc_id == 3 and r.n_tokens == 4]
    assert len(again) == 2 and again[0] == pytest.approx(again[1], abs=1e-4)


def test_scores_without_texts_that_teach(spark):
    import public_tokenizers

    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "some words"), (None, "more")], "doc_id long, text string")
    got = lm.score_documents(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, settings=lm.Settings(shape=SHAPE)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(2, 0, 0, 0.0), (3, 0, 0, 0.0)] and all(r.score < 0 for r in got)
    assert lm.score_documents(df.limit(0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, settings=lm.Settings(shape=SHAPE)).collect() == []


def test_held_out_texts_score_above_the_base(spark):
    got = Q.op13_lm_scores(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert got.s > got.b


def test_products_told_ahead_give_the_same_states():
    rng = np.random.default_rng(5)
    for shape in (attention.Shape(), attention.Shape(heads=2), attention.Shape(layers=2)):
        model = attention.fresh(shape, np.full(shape.slots, 1 / shape.slots), 3)
        model.weights["upb0"] = model.weights["upb0"] + np.float32(0.1)
        at = rng.integers(0, shape.slots, (5, shape.window))
        ahead = attention.told_ahead(model)
        assert (ahead is None) == (shape != attention.Shape())
        states = attention.states_of(model, ahead, at, attention._masked(shape))
        assert np.allclose(states, attention.trunk(model, at)[0], atol=1e-4)
        rows, targets = rng.permutation(at.size)[:3000], rng.integers(0, shape.slots, 3000)
        some = attention.log_chances(model, states.reshape(-1, shape.width), targets[:200], rows[:200])
        assert np.allclose(some, attention.log_chances(model, states.reshape(-1, shape.width)[rows[:200]], targets[:200]), atol=1e-5)


def test_lines_tell_frequent_words_from_others_and_shares_come_with_their_sums():
    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    size = max(int(x.split()[1]) for x in ranks.splitlines() if x) + 1
    slots = attention.slots_of(np.random.default_rng(1).integers(0, 50, size).astype(float), 3, attention.Shape())
    lines = lm.Lines(slots, ranks, pattern, {b"red": -1.0, b"fox": -2.0})
    for words in ([b"red", b"rarest", b"fox", b"rarest", b"red"], [b"rarest", b"unseen"], [], [b"fox"]):
        line, within, own, known, other = lines.of(words)
        plain, chance = lm.line_of(words, slots, ranks, pattern)
        assert line.tolist() == plain.tolist() and within == pytest.approx(chance)
        assert (own, known) == (sum({b"red": -1.0, b"fox": -2.0}.get(w, 0) for w in words), sum(w in (b"red", b"fox") for w in words))
        assert other == Counter(w for w in words if w not in (b"red", b"fox"))
    assert lines.add([b"new", b"newer"])[1] == [b"new", b"newer"] and set(lines.place) == {b"red", b"fox"}
    ahead = attention.told_ahead(attention.fresh(attention.Shape(), slots.prior, 3))
    assert (ahead[0][:, -1] == 1).all() and (ahead[1][:, -1] == 0).all()


def test_every_window_of_all_texts_is_learned_from(spark):
    """However few windows the beginning draws, the pass over all of them meets each once, and the model is better for it."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    rng, pattern = random.Random(4), public_tokenizers.PATTERN
    docs = [(i, " ".join(["the red fox", "a blue whale", "one green frog"][rng.randrange(3)] for _ in range(rng.randrange(400)))) for i in range(60)]
    learn = spark.createDataFrame(docs, "key long, text string").selectExpr("key", "CAST(text AS BINARY) AS text").repartition(3)
    counts = lm.word_counts(learn.select("text"))
    size = max(int(x.split()[1]) for x in ranks.splitlines() if x) + 1
    per_id = lm.id_counts(counts, ranks, pattern, size)
    slots = attention.slots_of(per_id, len(docs), SHAPE)
    s = lm.Settings(shape=SHAPE, sample=1, steps=1, whole_batch=8, whole_rate=0.01)
    lines = [np.concatenate(([SHAPE.slots - 1], lm.line_of(t.encode().split(), slots, ranks, pattern)[0], [SHAPE.slots - 1])) for _, t in docs]
    begun = attention.fresh(SHAPE, slots.prior, s.seed)
    model, n = lm.learn_whole(learn, begun, slots, ranks, pattern, {b"red": 3}, s)
    assert n == sum(-(-(len(line) - 1) // SHAPE.window) for line in lines)
    for line in lines[:5]:
        rows = attention.cut(line, SHAPE)
        assert np.concatenate([r[1:][r[1:] >= 0] for r in rows]).tolist() == line[1:].tolist()
    total = lambda m: sum(attention.score(m, iter([(line[1:-1], 0.0) for line in lines])))
    assert total(model) > total(begun) + 100
