"""Document operators against brute force on small fixtures with nulls, ties, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash

pytest.importorskip("ledgerloom.llm")
from ledgerloom.llm import bpe, langid, mixing, queries, simhash, substring  # noqa: E402

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return [] if text is None else SPLIT.findall(text.encode())


def corpus(seed=1, n=60):
    """(doc_id, text) with copies, near copies, shared passages, null, empty and wordless texts, odd white space and a repeated row."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéß") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(70)]
    rows = []
    for k in range(n):
        w = [word() for _ in range(r.choice([0, 1, 3, 30, 60, 140]))]
        if k % 5 == 0:
            at = r.randint(0, len(w))
            w = w[:at] + passage[r.randint(0, 15) :] + w[at:]
        if k % 7 == 0 and rows:
            w = (rows[-1][1] or "").split()
            if w and k % 2:
                w[len(w) // 2] = "CHANGED"
        rows.append((k * 3 % n if n % 3 else k, r.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " \n\t"), (n + 4, "x y z\x1cq"), (n + 5, "Only Three Words"), (n + 6, "only three words")]
    return rows + [rows[5], rows[5], (None, rows[5][1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def brute_print(text):
    w = [x.lower() for x in words_of(text)]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(nodes, linked):
    root = {a: a for a in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {a: find(a) for a in nodes}


def test_simhash_matches_brute_force(spark):
    rows = corpus() + [(1000 + k, f"near copy number {k % 3} of one text that all of these share " * 4) for k in range(12)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {i: brute_print(t) for i, t in rows if i is not None}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    for row in got:
        if row.doc_id is not None:
            assert (row.fp % (1 << 64), row.component_id) == (prints[row.doc_id], want[row.doc_id])
    assert {r.component_id for r in got if r.doc_id is None} == {want[corpus()[5][0]]}


@pytest.mark.parametrize(("distance", "segments"), [(4, 3), (4, 2), (3, 4), (0, 2)])
def test_hamming_links_lose_no_component(spark, distance, segments):
    r = random.Random(distance * 10 + segments)
    prints = {}
    for k in range(150):
        base = prints[r.randrange(k)] if k and r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.randint(0, 6)):
            base ^= 1 << r.randrange(64)
        prints[k] = base
    seen = {}
    for k, f in prints.items():
        seen.setdefault(f, k)
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for f, k in seen.items()], "rep long, fp long")
    links = [(x.src, x.dst) for x in simhash.hamming_links(df, distance, segments).collect()]
    reps = sorted(seen.values())
    want = brute_components(reps, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= distance)
    edges = {frozenset(x) for x in links}
    assert brute_components(reps, lambda a, b: frozenset((a, b)) in edges) == want


def brute_kept(rows):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for at in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[at : at + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for at in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[at : at + 50])] < i:
                gone.update(range(at, at + 50))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_matches_brute_force(spark, seed):
    rows = corpus(seed) + [(500, "again and " * 90), (501, "again and " * 60), (501, "other text under the same id")]
    got = substring.remove_repeats(frame(spark, rows).selectExpr("*", "'x' AS kept", "1 AS doc")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_kept(rows)
    assert {r.doc for r in got} == {1}


def test_substring_resolves_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(substring, "WORDS_AT_ONCE", 100)
    monkeypatch.setattr(substring, "WINDOWS_AT_ONCE", 50)
    rows = corpus(4)
    got = substring.remove_repeats(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_kept(rows)


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_substring_with_a_wide_sketch_and_a_tree(spark, monkeypatch, broadcast):
    """The sketch as a table, groups combined in several levels, and a window that all documents share."""
    monkeypatch.setattr(substring, "BROADCAST", broadcast)
    monkeypatch.setattr(substring, "FAN_IN", 2)
    monkeypatch.setattr(substring, "BATCH_BYTES", 2_000)
    monkeypatch.setattr(substring, "WINDOWS_AT_ONCE", 50)
    r = random.Random(9)
    hot = " ".join(f"hot{k}" for k in range(75))
    rows = corpus(5) + [(2000 + k, " ".join(f"w{r.randrange(10**6)}" for _ in range(k % 40)) + " " + hot) for k in range(80)] + [(3000, "again " * 400), (3001, "again " * 30 + hot)]
    assert len(substring.lanes_of(sum(len((t or "").encode()) for _, t in rows))) >= 2
    got = substring.remove_repeats(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_kept(rows)


def test_sketch_follows_the_input():
    """At any size 4 to 8 counters a minimiser, so that few unique windows pass; nothing bounds the width."""
    for n in (10**9, 10**11, 10**14, 10**16):
        assert 4 <= substring.sketch_width(n) / (n / 120) <= 8.01
        share = 1 - math.exp(-(n / 120) / substring.sketch_width(n))
        assert share**2 < 0.1


def test_very_long_texts(spark):
    """A text of 120,000 words and its copy, beside short ones: windows, fingerprints and sizes of the whole."""
    r = random.Random(12)
    long = " ".join(f"w{r.randrange(10**9)}" for _ in range(120_000))
    rows = [(1, long), (2, long), (3, "short text"), (4, long + " and a tail of its own")]
    df = frame(spark, rows).selectExpr("*", "'s' AS source", "7 AS size", "'t' AS target", "0 AS fp", "1 AS component_id", "2 AS copies")
    gone = {x.doc_id: (x.n_words, x.n_removed) for x in substring.remove_repeats(df).collect()}
    assert gone == {1: (120_000, 0), 2: (120_000, 120_000), 3: (2, 0), 4: (120_006, 120_000)}
    prints = {x.doc_id: (x.fp % (1 << 64), x.component_id) for x in simhash.near_duplicates(df).collect()}
    assert prints[1] == prints[2] == (brute_print(long), 1) and prints[4][1] == 1 and prints[3][1] == 3
    mixed = {x.doc_id: (x.size, x.source_size) for x in mixing.mix(df, carry=["size", "target", "fp", "text"]).collect()}
    assert mixed == {1: (120_000, 360_008), 2: (120_000, 360_008), 3: (2, 360_008), 4: (120_006, 360_008)}


def test_mix_refuses_a_part_of_a_copy(spark):
    with pytest.raises(ValueError, match="whole"):
        mixing.mix(spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string"), most=1.5)


def test_few_unique_windows_are_candidates(spark, monkeypatch):
    """Texts without repeats, a sketch of 4 to 8 counters a minimiser: under a tenth of the runs of windows is estimated repeated."""
    monkeypatch.setattr(substring, "BLOCK", 8)
    r = random.Random(3)
    rows = [(k, " ".join(f"w{r.randrange(10**9)}" for _ in range(500))) for k in range(60)]
    docs = frame(spark, rows).selectExpr("doc_id AS doc", "xxhash64(text) AS mark", "cast(text AS binary) AS text")
    n_bytes = sum(len(t) for _, t in rows)
    spans = substring.repeated_spans(docs, substring.sketch_width(n_bytes)).collect()
    windows = sum(s & 0xFFFFFFFF for x in spans for s in x.spans)
    assert windows / (60 * 451) < 0.1


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        open_w = sum(w[s] for s in names if s not in full)
        left = budget - sum(full.values())
        over = [s for s in names if s not in full and left * w[s] / open_w > most * sizes[s]]
        if not over:
            return {s: full.get(s, left * w[s] / open_w if open_w else 0.0) for s in names}
        full |= {s: most * sizes[s] for s in over}


def test_mixing_reaches_targets(spark):
    r = random.Random(5)
    rows = [(k, r.choice([None, "", "one", "two words"]) if k % 9 == 0 else "w " * int(r.paretovariate(1.1) * 5), r.choice(["b", "a", "é", "Z", None, "a"])) for k in range(900)]
    rows += [(10_000 + k, "w " * 7, "hot") for k in range(900)] + [(5, "a b c", "a")] * 3 + [(None, "n n", "a"), (7, None, "dry")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df, block_rows=100).collect()
    again = mixing.mix(df.repartition(2), block_rows=100).collect()
    key = lambda x: sorted((str(r.doc_id), r.size, r.taken) for r in x)
    assert key(got) == key(again) and len(got) == len(rows)
    sizes, taken, largest = {}, {}, {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        largest[x.source] = max(largest.get(x.source, 0), x.size)
        assert x.taken <= 2 * x.size and x.taken == x.copies * x.size
    want = brute_targets(sizes)
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * largest[s]


def test_mixing_plan_is_native(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_tiktoken_and_round_trips(spark, tiktoken_encoding, sf):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "don't  \n\n\tstop 　x "), (-4, "日本語 中文 ١٢٣ 🙂🙂 é"), (-5, "a" * 5000), (-6, "<|endoftext|> 1234567"), (-7, "ab " * 70_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == texts[r.doc_id].encode()
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_perfect_hash_is_minimal_and_exact():
    ranks = {f"k{i}".encode(): i for i in range(3000)}
    table = bpe.PerfectHash(ranks)
    assert sorted(table.ranks) == list(range(3000)) and len(table.keys) == 3000
    assert all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"absent") is None and bpe.PerfectHash({}).get(b"x") is None


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "123 !?", None, "s", 1), (None, "the and of", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "0 AS score")
    got = langid.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == docs.count() and set(got[0].asDict()) == {*docs.columns, "held_out", "lang_pred", "score", "strange"}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (-1, -2, -3))
    held = [r for r in got if r.held_out and r.doc_id >= 0]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def plain_grams(text):
    """Hashed n-grams of one to three characters, one by one."""
    out = {}
    run = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split(" "))
    while "  " in run:
        run = run.replace("  ", " ")
    run = " " + run.strip(" ") + " " if run.strip(" ") else " "
    for n in (1, 2, 3):
        for at in range(len(run) - n + 1):
            g = 0
            for c in run[at : at + n]:
                g = (g * 0x100000001B3 + ord(c) + 1) % (1 << 64)
            g = (g * 0x9E3779B97F4A7C15) % (1 << 64) >> 50
            out[g] = out.get(g, 0) + 1
    return out


def plain_model(rows, labels, penalty, epochs=2, alpha=0.5, beta=1.0, seed=7):
    """Weights by label of sparse rows ({bucket: value}, label), coordinate by coordinate; bucket -1 is the bias."""
    import numpy as np

    z, n = {}, {}

    def weight(b, k):
        bound = 0.0 if b == -1 else penalty[0]
        v = z.get((b, k), 0.0)
        return 0.0 if abs(v) <= bound else -(v - math.copysign(bound, v)) / ((beta + math.sqrt(n.get((b, k), 0.0))) / alpha + penalty[1])

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            x, y = rows[r]
            x = {**x, -1: 1.0}
            w = {(b, k): weight(b, k) for b in x for k in labels}
            logit = [sum(v * w[b, k] for b, v in x.items()) for k in labels]
            top = [math.exp(v - max(logit)) for v in logit]
            for k, p in zip(labels, top, strict=True):
                gap = p / sum(top) - (k == y)
                for b, v in x.items():
                    g, old = gap * v, n.get((b, k), 0.0)
                    z[b, k] = z.get((b, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[b, k]
                    n[b, k] = old + g * g
    return lambda x, k: weight(-1, k) + sum(v * weight(b, k) for b, v in x.items())


def test_language_id_matches_a_plain_version(spark):
    """TF-IDF, FTRL with both penalties, and the temperature, written out for one penalty on short texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "substring(text, 1, 60) AS text", "lang").where("doc_id < 250").repartition(2)
    penalty = (0.02, 0.1)
    settings = langid.Settings(penalties=(penalty,))
    got = {r.doc_id: r for r in langid.identify(docs, settings=settings).collect()}
    rows = sorted((tuple(r) for r in docs.selectExpr("xxhash64(doc_id, text)", "lang", "doc_id", "text").collect()), key=lambda r: (r[0], r[1]))
    learned = [r for r in rows if zlib.crc32(str(r[2]).encode()) % 3 != 1]
    labels = sorted({r[1] for r in learned})
    df = {}
    for r in learned:
        for g in plain_grams(r[3]):
            df[g] = df.get(g, 0) + 1

    def vector(text):
        x = {g: math.log1p(c) * (math.log((1 + len(learned)) / (1 + df.get(g, 0))) + 1) for g, c in plain_grams(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / norm for g, v in x.items()}

    seen, unseen = [r for k, r in enumerate(learned) if k % 5], learned[::5]
    logit = plain_model([(vector(r[3]), r[1]) for r in seen], labels, penalty)
    told = [([logit(vector(r[3]), k) for k in labels], r[1]) for r in unseen]

    def probabilities(logits, t):
        top = [math.exp((v - max(logits)) / t) for v in logits]
        return [v / sum(top) for v in top]

    def loss(t):
        smooth, out = 1 / (len(told) + len(labels)), 0.0
        for logits, y in told:
            for k, p in zip(labels, probabilities(logits, t), strict=True):
                out -= (smooth + (k == y) * len(told) * smooth) * math.log(p)
        return out

    t = min((math.exp(k / 400) for k in range(-1600, 1600)), key=loss)
    for r in rows[:60]:
        p = probabilities([logit(vector(r[3]), k) for k in labels], t)
        assert got[r[2]].lang_pred == labels[p.index(max(p))] and got[r[2]].score == pytest.approx(max(p), abs=5e-3)


def test_language_penalties_select_and_scores_are_calibrated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    assert 0.5 < (model.weights == 0).mean() and (model.weights != 0).any()
    assert 1e-3 < model.temperature < 1e3 and model.calibration_error < 0.05


def test_temperature_is_finite_where_all_is_told_right():
    import numpy as np

    logits = np.array([[5.0, 0.0], [0.0, 5.0], [4.0, 0.0]] * 20)
    labels = np.array([0, 1, 0] * 20)
    t = langid.temperature_of(logits, labels)
    assert 0.3 < t < 3 and langid.softmax(logits / t).max() < 0.999
    assert langid.temperature_of(logits * 1e-3, labels) == pytest.approx(t * 1e-3, rel=1e-2)


def test_too_many_labels_are_refused(spark):
    docs = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        langid.train(docs, settings=langid.Settings(most_labels=5))


def test_language_of_repeated_and_very_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where("lang = 'en'").first()
    more = spark.createDataFrame([(5000, one.text, None), (5000, one.text, None), (5001, one.text * (2_000_000 // len(one.text)), None)], docs.schema)
    got = [r for r in langid.identify(docs.unionByName(more)).collect() if r.doc_id >= 5000 or r.doc_id == one.doc_id]
    assert len(got) == 4 and {r.lang_pred for r in got} == {"en"} and len({r.score for r in got if r.doc_id != 5001}) == 1


def test_bpe_of_a_very_long_pretoken_and_clashing_columns(spark, tiktoken_encoding):
    import public_tokenizers

    r = random.Random(6)
    long = "".join(r.choice("abcdefghijklmnop") for _ in range(200_000))
    rows = [(1, long), (1, long), (None, "x y"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'i' AS id", "array(1) AS ids", "2 AS n_tokens")
    got = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    want = {t: tiktoken_encoding.encode_ordinary(t) for _, t in rows}
    assert sorted((str(x.doc_id), x.n_tokens) for x in got) == sorted((str(i), len(want[t])) for i, t in rows)
    assert all(list(x.ids) == want[bytes(x.decoded).decode()] for x in got)


def test_language_features_cover_whole_texts(monkeypatch):
    import numpy as np

    s = langid.Settings()
    text = "Größe and 12 ça va, niño — übung" * 9
    whole = langid.features(text, s)[0]
    monkeypatch.setattr(langid, "PIECE", 7)
    assert np.array_equal(langid.features(text, s)[0], whole)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    import public_tokenizers

    for df in (
        simhash.near_duplicates(docs),
        substring.remove_repeats(docs),
        mixing.mix(docs),
        langid.identify(docs),
        bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    ):
        assert df.count() == 0


@pytest.mark.parametrize("name", ["op3_byte_bpe", "op5_substring_dedup", "op7_source_mix", "op8_language_id", "op10_simhash"])
def test_queries_return_one_row_per_document(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in queries.QUERIES[name](spark, sf).select("doc_id").collect()) == sorted(r.doc_id for r in docs.collect())
