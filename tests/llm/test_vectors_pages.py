"""Vector, page and token-count operators against brute force on small fixtures."""

import base64
import gzip
import hashlib
import io
import math
import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerloom.llm")
from ledgerloom.llm import curves, nndescent, trie_counts, urlgraph, warc  # noqa: E402


def vectors(seed=3, width=12, n=220):
    """Isotropic vectors with chains, dense groups, scaled and exact copies, and unusable rows."""
    r = np.random.default_rng(seed)
    rows = [(int(k), r.normal(size=width)) for k in range(n)]
    for k in range(0, 60, 3):
        rows.append((n + k, rows[k][1] + r.normal(size=width) * 0.15))
    centre = r.normal(size=width)
    rows += [(1000 + k, centre + r.normal(size=width) * 0.05) for k in range(90)]
    rows += [(2000 + k, rows[5][1] * (1 if k < 3 else 7.0)) for k in range(5)]
    rows = [(i, v.tolist()) for i, v in rows]
    odd = [(3000, None), (3001, [0.0] * width), (3002, [None] + [1.0] * (width - 1)), (3003, [float("nan")] * width), (3004, [float("inf")] * width), (3005, None)]
    return rows + odd


def units(rows):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([v for _, v in good])
    return [i for i, _ in good], x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nn_descent_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 32)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'a' AS node", "1 AS n").repartition(3)
    got = {r.vec_id: r for r in nndescent.near_duplicates(df).collect()}
    ids, x = units(rows)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    root = {i: i for i in ids}
    for _ in range(len(ids)):
        new = {i: min([root[i], *(root[ids[j]] for j in np.flatnonzero(hit[k]))]) for k, i in enumerate(ids)}
        if new == root:
            break
        root = new
    assert len(got) == len(rows)
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[k].sum(), root[i], root[i] == i)
    for i in set(got) - set(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_links_by_balls_match_brute_force(spark, monkeypatch):
    """A tight group, whose balls link whole, a wide one and a chain, whose balls are in doubt, and what is far apart; several tiles."""
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    monkeypatch.setattr(nndescent, "TILE", 4)
    r = np.random.default_rng(11)
    u, v, w = np.linalg.qr(r.normal(size=(10, 3)))[0].T
    points = [u + r.normal(size=10) * 0.02 for _ in range(200)] + [v + r.normal(size=10) * 0.2 for _ in range(150)]
    points += [np.cos(t) * w + np.sin(t) * u + r.normal(size=10) * 0.01 for t in np.linspace(0.3, 1.5, 90)]
    rows = [(0, k, 1 + k % 3, np.asarray(p, "<f8").tobytes()) for k, p in enumerate(points)] + [(5, 900 + k, 2, np.asarray(u + k, "<f8").tobytes()) for k in range(2)]
    df = spark.createDataFrame(rows, "component long, node long, n long, vec binary").repartition(3)
    got = {x.node: x.links for x in nndescent.links_within(df, 0.9, "<f8").collect()}
    x = np.array(points)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    assert {k: got[k] for k in range(len(points))} == dict(enumerate((hit @ np.array([1 + k % 3 for k in range(len(points))])).tolist()))
    assert set(got) - set(range(len(points))) == {900, 901}


def test_query_of_near_vectors_matches_brute_force(spark, sf):
    from ledgerloom.llm import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.QUERIES["op1_embedding_near_dedup"](spark, sf).collect()}
    assert got == brute_links(rows)


def test_nn_descent_repeated_rows_and_null_ids(spark):
    v = [1.0, 2.0]
    got = nndescent.near_duplicates(spark.createDataFrame([(1, v), (1, v), (2, v), (None, v), (3, [2.0, -1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got)) == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def brute_links(rows, threshold=0.9):
    """n_links and component of every id."""
    ids, x = units(rows)
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    root = {i: i for i in ids}
    while True:
        new = {i: min([root[i], *(root[ids[j]] for j in np.flatnonzero(hit[k]))]) for k, i in enumerate(ids)}
        if new == root:
            return {i: (hit[k].sum(), root[i]) for k, i in enumerate(ids)}
        root = new


def test_nn_descent_does_not_lose_pairs_behind_a_hot_group(spark):
    """A weak search finds the hot group and misses pairs; the hot group's many links don't make that pass."""
    r = np.random.default_rng(8)
    centre = r.normal(size=24)
    rows = [(k, (centre + r.normal(size=24) * 0.05).tolist()) for k in range(300)]
    for k in range(300, 600):
        v = r.normal(size=24)
        rows.append((k, v.tolist()))
        rows.append((k + 1000, (v + r.normal(size=24) * 0.35).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(df, k=2, tables=1, rounds=0).collect()}
    assert got == brute_links(rows)


def test_links_without_room_in_a_list_still_connect_groups(spark):
    """Of a node's five links a list of two keeps the nearest; the rest are told apart, and those between components are picked."""
    rows = [(0, b, 0.99 - b / 100) for b in range(1, 6)] + [(0, 9, 0.5)]
    kept, crowded = nndescent.best_of(spark.createDataFrame(rows, nndescent.PAIR), 2, 0.9, 2)
    assert sorted((r.a, r.b) for r in kept.collect()) == [(0, 1), (0, 2)]
    assert sorted((r.a, r.b) for r in crowded.collect()) == [(0, 3), (0, 4), (0, 5)]
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)], "node long, component long")
    assert sorted((r.a, r.b) for r in nndescent.between(crowded, labels).collect()) == [(0, 4), (0, 5)]


def test_nn_descent_joins_two_tight_groups(spark):
    """Two groups whose cross pairs often reach the threshold, but never the place of pairs inside a group; no audit, one search."""
    r = np.random.default_rng(4)
    u = r.normal(size=64)
    u /= np.linalg.norm(u)
    w = r.normal(size=64)
    w -= (w @ u) * u
    w /= np.linalg.norm(w)
    far = 0.915 * u + np.sqrt(1 - 0.915**2) * w
    rows = [(300 * g + k, (c + r.normal(size=64) * 0.015).tolist()) for g, c in enumerate((u, far)) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(df, k=2, rounds=1, recall=0.0).collect()}
    assert got == brute_links(rows)


def test_curves_find_the_nearest_with_exact_scores(spark):
    rows = [(i, v) for i, v in vectors(n=800)]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>").repartition(3)
    got = curves.nearest(df, every=10).collect()
    ids, x = units(rows)
    asked = [k for k, i in enumerate(ids) if i % 10 == 0]
    hits = 0
    for k in asked:
        mine = sorted((r for r in got if r.query_id == ids[k]), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert [(r.score, r.vec_id) for r in mine] == sorted(((r.score, r.vec_id) for r in mine), key=lambda t: (-t[0], t[1]))
        for r in mine:
            assert r.score == pytest.approx(float(x[k] @ x[ids.index(r.vec_id)]), abs=1e-12)
        best = sorted((-round(float(x[k] @ x[j]), 12), ids[j]) for j in range(len(ids)) if j != k)[:5]
        hits += len({i for _, i in best} & {r.vec_id for r in mine})
    assert hits / (5 * len(asked)) >= 0.9
    assert {r.query_id for r in got} == {ids[k] for k in asked}


def clustered(n, seed=2, width=24, size=40):
    """Clusters of `size` vectors around isotropic centres."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // size, width))
    return [(k, (centres[k % len(centres)] + r.normal(size=width) * 0.1).tolist()) for k in range(n)]


def test_windows_do_not_grow_with_the_rows_where_vectors_cluster(spark):
    """What a query is compared with, at most three windows an ordering, is the same for three times the rows."""
    windows = set()
    for n in (2000, 6000):
        df = spark.createDataFrame(clustered(n), "vec_id long, embedding array<double>").repartition(3)
        got = curves.nearest(df, orderings=4, window=64).collect()
        assert len(got) == 5 * n // 50
        windows |= {(r.window, r.audited_recall >= 0.95) for r in got}
    assert windows == {(64, True)}


def test_windows_widen_until_the_audit_finds_enough(spark):
    """Isotropic vectors, of which a narrow window holds few neighbours: the recall that is told is the recall there is."""
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = curves.nearest(df, window=16, audited=1000).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for k in range(0, 1500, 50):
        best = [j for j in np.argsort(-(x[k] @ x.T)) if j != k][:5]
        hits += len(set(best) & {g.vec_id for g in got if g.query_id == k})
    assert got[0].window > 16 and got[0].audited_recall >= 0.95 and hits / 150 == pytest.approx(got[0].audited_recall)


def test_windows_cross_partitions_and_lanes(spark, monkeypatch):
    """Small cells, and windows that end within partitions: what three windows hold is what is compared."""
    monkeypatch.setattr(curves, "CELL", 16)
    rows = vectors(n=300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = curves.nearest(df, every=10, window=512)
    ids, x = units(rows)
    want = set()
    for k, i in enumerate(ids):
        if i % 10 == 0:
            best = sorted((-float((x[k] * x[j]).sum()), ids[j]) for j in range(len(ids)) if j != k)
            want |= {(i, r + 1, j) for r, (_, j) in enumerate(best[:5])}
    exact = {(r.query_id, r.rank, r.vec_id) for r in got.collect()}
    assert len(exact) == len(want) and len(exact & want) / len(want) > 0.97  # scaled copies tie up to rounding


def test_a_hot_vector_neither_crowds_windows_nor_hides_its_smallest_ids(spark):
    r = np.random.default_rng(5)
    hot = r.normal(size=8).tolist()
    rows = [(k, hot) for k in range(0, 3000, 3)] + [(k, r.normal(size=8).tolist()) for k in range(3000) if k % 3]
    got = curves.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), window=64).collect()
    asked = [k for k in range(0, 3000, 3) if k % 50 == 0]
    for k in asked:
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == k), key=lambda r: r.rank)]
        assert mine == [i for i in range(0, 18, 3) if i != k][:5]
    assert len(got) == 5 * 60


def test_vectors_of_another_length_and_clashing_columns(spark):
    rows = [(k, [float(k % 7), 1.0, 2.0]) for k in range(1, 60)] + [(50, [1.0, 2.0]), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'n' AS node", "1 AS id", "'v' AS vec", "0 AS score", "2 AS rank")
    got = curves.nearest(df).collect()
    assert {r.query_id for r in got} == {50} and [r.rank for r in sorted(got, key=lambda r: r.rank)] == [1, 2, 3, 4, 5]
    dups = nndescent.near_duplicates(df).collect()
    assert len(dups) == len(rows) and [(r.n_links, r.component_id) for r in dups if r.vec_id == 100] == [(0, 100)]


def test_nearest_query_matches_brute_force(spark, sf):
    from ledgerloom.llm import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = units(rows)
    got = {}
    for r in queries.QUERIES["op9_nearest_neighbours"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids if i % 50 == 0}
    hits = 0
    for k, i in enumerate(ids):
        if i % 50 == 0:
            best = [ids[j] for j in np.lexsort((ids, -(x[k] * x).sum(1))) if j != k][:5]
            hits += len({v for v, _ in got[i].values()} & set(best))
            assert all(s == pytest.approx(float(x[k] @ x[ids.index(v)]), abs=1e-12) for v, s in got[i].values())
    assert hits / (5 * len(got)) >= 0.9


def test_curves_with_few_or_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in curves.nearest(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert curves.nearest(few.where("false")).count() == 0
    assert nndescent.near_duplicates(few.where("false")).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_hilbert_keys_walk_every_cell_in_unit_steps(dims, bits):
    cells = np.array(list(np.ndindex(*[1 << bits] * dims)))
    keys = curves.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def pages():
    big = "<html>" + "é\r\n\r\nWARC/1.1\r\n" * 400
    return [(3, "http://a/1", "x"), (1, "http://a/2", "x"), (2, None, None), (9, "u", ""), (7, "http://é/?q=1\r\nX: y", big), (8, "http://b", big), (8, "http://b", big), (None, "http://n", "x"), (None, None, "only")]


@pytest.mark.parametrize("least", [0, 2])
def test_warc_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame([(*p, "z") for p in pages()], "page_id long, url string, html string, payload string").repartition(2)
    got = warc.captures_of(df, str(tmp_path / "w"), least_bytes=least).collect()
    firsts = {}
    for i, _, h in pages():
        firsts.setdefault(h or "", []).append(math.inf if i is None else i)
    want = []
    for h, ids in firsts.items():
        raw = h.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        for k, i in enumerate(sorted(ids)):
            again = k > 0 and len(raw) >= least
            want.append((None if i == math.inf else i, len(raw), digest, "revisit" if again else "response", min(ids) if again else None))
    key = lambda t: str(t)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Small payloads share files, large ones get few or one each; a frame that numbers its rows differently each time makes no difference."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    monkeypatch.setattr(warc, "CAPTURES_PER_ARCHIVE", 40)
    rows = [(k, f"http://s/{k}", f"{k} " * 20) for k in range(200)] + [(1000 + k, f"http://m/{k}", str(k) * 7_000) for k in range(9)] + [(2000 + k, "http://l", f"x{k % 2}" * 500_000) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").orderBy(F.rand())
    got = {r.page_id: r for r in warc.captures_of(df, str(tmp_path / "w")).collect()}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == {i: (len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows}
    assert [got[2000 + k].refers_to for k in range(4)] == [None, None, 2000, 2001]
    sizes = []
    for file in (tmp_path / "w").glob("*.gz"):
        payloads = [len(b) for h, b in warc.parse_records(io.BytesIO(gzip.decompress(file.read_bytes()))) if h["warc-type"] == ["response"]]
        assert sum(payloads) <= 60_000 or len(payloads) == 1
        sizes.append(len(payloads))
    assert max(sizes) > 20


def test_warc_of_very_long_pages(spark, tmp_path):
    """A page of three megabytes and its copy, with columns called as those of records."""
    long = "<p>é</p>" * 400_000
    df = spark.createDataFrame([(1, "http://a", long), (2, "http://b", long), (3, "http://c", "x")], "page_id long, url string, html string").selectExpr("*", "'t' AS type", "1 AS nonce", "'s' AS sha256", "0 AS bytes")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.captures_of(df, str(tmp_path / "w")).collect()}
    assert got == {1: (len(long.encode()), "response", None), 2: (len(long.encode()), "revisit", 1), 3: (1, "response", None)}


def test_warc_assembly_and_payloads(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(pages(), "page_id long, url string, html string"), path)
    got = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(got) == len(pages())
    payloads = sorted(bytes(r.response.payload).decode() for r in got if r.response.type == "response" or r.response.payload)
    assert set(payloads) - {""} == {h for _, _, h in pages() if h}
    assert all(r.request.uri == r.response.uri and len(r.metadata) == 1 for r in got)
    assert all(r.response.computed_digest in (None, r.response.payload_digest) for r in got)


def test_warc_reads_foreign_archives(spark, tmp_path):
    def record(kind, rid, block, *more, mime="application/http; msgtype=response"):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *more, f"Content-Type: {mime}", f"Content-Length: {len(block)}"])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    records = [record("warcinfo", "w", b"software: x\r\n", mime="application/warc-fields"), record("response", "r", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\xff"), record("request", "q", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r>"), record("metadata", "m", b"k: v\r\n", "WARC-Concurrent-To: <q>", mime="application/warc-fields"), record("metadata", "lost", b"", "WARC-Concurrent-To: <nowhere>", mime="application/warc-fields")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (one,) = warc.assemble(warc.read_archives(spark, str(tmp_path))).collect()
    assert bytes(one.response.payload) == b"body\xff" and one.request.record_id == "<q>" and [m.record_id for m in one.metadata] == ["<m>"]
    assert warc.captures_of(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none")).count() == 0


def brute_judge(rows, rules, rounds=300, damping=0.85, threshold=1.0):
    """PageRank by its definition: every round, hosts without links out send all they have to the seeds."""
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    def parse(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        return lower(rest[:cut]), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]

    out, hosts, edges, seeds = [], set(), {}, {"allow": {}, "block": {}}
    for i, url, html in rows:
        host, path = parse(url)
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
        out.append((i, host, path, best))
        if host:
            hosts.add(host)
            for link in html or []:
                if lower(link) and lower(link) != host:
                    edges[host, lower(link)] = edges.get((host, lower(link)), 0) + 1
            if best:
                seeds[best[0]][host] = seeds[best[0]].get(host, 0) + 1
    for h in hosts:
        above = h.split(".", 1)[-1]
        if above in hosts and above != h:
            edges[h, above] = edges.get((h, above), 0) + 1
    score = {}
    for kind in seeds:
        total = sum(seeds[kind].values())
        seed = {h: n / total for h, n in seeds[kind].items()}
        flow = {(a, b) if kind == "allow" else (b, a): n for (a, b), n in edges.items()}
        degree = {}
        for (a, _), n in flow.items():
            degree[a] = degree.get(a, 0) + n
        rank = dict(seed)
        for _ in range(rounds):
            lost = sum(v for h, v in rank.items() if h not in degree)
            new = {h: s * (1 - damping + damping * lost) for h, s in seed.items()}
            for (a, b), n in flow.items():
                if a in rank:
                    new[b] = new.get(b, 0) + damping * rank[a] * n / degree[a]
            rank = new
        score[kind] = rank
    told = []
    for i, host, path, best in out:
        gap = (score["block"].get(host, 0) - score["allow"].get(host, 0)) * len(hosts)
        told.append((i, host, path, best[1] + best[2] if best else None, best[0] if best else "block" if gap > threshold else "allow"))
    return told


def test_url_verdicts_match_brute_force(spark):
    r = random.Random(4)
    names = [f"{a}{b}" for a in ("", "www.", "m.") for b in ("x.com", "y.example.com", "example.net", "z.org", "w.example.org", "solo.io")]
    rows = []
    for k in range(300):
        host = r.choice(names) if k % 3 else "www.y.example.com"
        path = r.choice(["", "/", "/en/7x", "/en/1", "/de/8", "/de/1?x=/es/", "/es/#a", "/fr"])
        links = [r.choice(names) for _ in range(r.randint(0, 3))]
        rows.append((k, r.choice(["http://", "HTTPS://", "a://"]) + (host.upper() if k % 7 == 0 else host) + path, links))
    rows += [(900, None, ["x.com"]), (901, "no scheme/x", []), (902, "http://", None), (903, "x://?a://b/", []), (0, "http://x.com/en/", None)]
    html = [(i, u, None if h is None else "".join(f"<a class=l href='https://{x.upper() if i % 2 else x}/p'>t</a><a href=/en/>" for x in h)) for i, u, h in rows]
    df = spark.createDataFrame(html, "page_id long, url string, html string").selectExpr("*", "'q' AS host").repartition(3)
    got = urlgraph.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_judge(rows, urlgraph.RULES), key=str)
    assert {v for *_, rule, v in map(tuple, got) if rule is None} == {"allow", "block"}
    assert urlgraph.judge(df.where("false")).count() == 0


def test_trust_settles_on_cycles_and_long_pages(spark):
    """Hosts in a ring, a dead end and a page of two megabytes: scores to within the precision of the definition."""
    ring = [f"h{k}.example" for k in range(6)]
    rows = [(k, f"http://{h}/", [ring[(k + 1) % 6]] + (["end.example"] if k == 2 else [])) for k, h in enumerate(ring)]
    rows += [(90, "http://end.example/", []), (91, "http://good.net/de/", [ring[0]]), (92, "http://bad.com/en/", [ring[3]]), (93, "http://x.org/es/", ["good.net"]), (93, "http://x.org/es/", ["good.net"])]
    html = [(i, u, "".join(f"<a href='http://{x}/'>" for x in links) + ("x" * 2_000_000 if i == 91 else "")) for i, u, links in rows]
    got = {r.host: r for r in urlgraph.judge(spark.createDataFrame(html, "page_id long, url string, html string").repartition(3)).collect()}
    hosts = sorted(got)
    pairs = [(h, x) for (_, u, links) in rows for h in [u.split("/")[2]] for x in links]
    for kind, seeds, column in (("f", {"good.net": 1}, "trust"), ("b", {"bad.com": 1, "x.org": 2}, "distrust")):
        m = np.zeros((len(hosts), len(hosts)))
        for a, b in pairs:
            a, b = (a, b) if kind == "f" else (b, a)
            m[hosts.index(b), hosts.index(a)] += 1
        s = np.array([seeds.get(h, 0) for h in hosts]) / sum(seeds.values())
        degree = m.sum(0)
        m = np.where(degree > 0, m / np.maximum(degree, 1), s[:, None])
        want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * m, 0.15 * s) * len(hosts)
        assert [got[h][column] for h in hosts] == pytest.approx(want.tolist(), abs=2e-3)


def test_token_counts_match_plain_dynamic_programming(spark, sf):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = trie_counts.read_scores(path)
    unigram = trie_counts.Unigram(scores)

    @lru_cache(None)
    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + n * unigram.byte_score, best[end - 1][1] - n)]
            options += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "日本語 🙂 " + "x" * 300), (None, "the the cat"), (-4, "the the cat")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    got = sorted(trie_counts.count_tokens(docs, path).collect(), key=lambda r: str((r.doc_id, None)))
    want = {i: [w.decode() for w in (t or "").encode().split()] for i, t in texts}
    assert len(got) == len(texts)
    for r in got:
        words = want[r.doc_id]
        assert (r.n_pretokens, r.n_distinct) == (len(words), len(set(words)))
        assert r.n_tokens == sum(plain("▁" + w) for w in words)
    assert trie_counts.count_tokens(docs.where("false"), path).count() == 0


def test_trie_shares_prefixes_and_bounds_depth(monkeypatch):
    """A node a distinct prefix, computed once; the same counts with shallow and with small tries."""
    scores = {"▁": -5.0, "a": -3.0, "ab": -4.0, "▁ab": -6.0, "b": -3.5, "abab": -7.0, "c": -2.0}
    unigram = trie_counts.Unigram(scores)
    words = ["▁abab", "▁ab", "▁abc", "▁ababababababé", "▁c" * 40]
    trie = trie_counts.Trie(unigram)
    calls = []
    step = unigram.step
    monkeypatch.setattr(unigram, "step", lambda *a: calls.append(a) or step(*a))
    whole = [trie.tokens(w) for w in words]
    prefixes = {w[:k] for w in words for k in range(1, min(len(w), trie_counts.DEPTH) + 1)}
    assert len(trie.forward) == len(prefixes) + 1 and len(calls) == len(prefixes) + sum(max(0, len(w) - trie_counts.DEPTH) for w in words)
    assert [trie.tokens(w) for w in words[:4]] == whole[:4] and len(trie.forward) == len(prefixes) + 1
    monkeypatch.setattr(trie_counts, "DEPTH", 2)
    assert [trie_counts.Trie(unigram).tokens(w) for w in words] == whole


def test_token_counts_of_long_words_in_bounded_tries(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    long = "日本語" * 30_000
    docs = spark.createDataFrame([(1, long), (1, long), (2, "some words " * 5_000)], "doc_id long, text string").selectExpr("*", "'i' AS id", "0 AS n_tokens")
    got = sorted(map(tuple, trie_counts.count_tokens(docs, path).collect()))
    unigram = trie_counts.Unigram(trie_counts.read_scores(path))
    tokens = trie_counts.Trie(unigram).tokens
    assert got == [(1, 1, 1, tokens("▁" + long))] * 2 + [(2, 10_000, 2, 5_000 * (tokens("▁some") + tokens("▁words")))]


@pytest.mark.parametrize("name", ["op6_url_filter", "op7_source_mix"])
def test_queries_match_their_sql(spark, sf, name):
    import duckdb

    from ledgerloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    plain = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())
