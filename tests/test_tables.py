"""Items, tables by place, and one-to-one matches against plain loops and generated pages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from ledgerloom.operators import items as I
from ledgerloom.operators import labelled
from ledgerloom.operators import layout as L
from ledgerloom.operators import match
from pyspark.sql import functions as F

CATALOGUE = """Partida Concepto Cantidad Unidad
12.
Suministro de tubería
de acero
4,5
PZA
13.
Bombas
LOTE
2
14.
Válvulas tipo mariposa
MARCA X
7 | Grúa de patio | 3.5 | Pzas.
8 | El licitante deberá entregar planos | 1 | LOTE
9 | Tornillos varios | 2 | cajas
A-12 | Norma NOM-001 | 2 | cajas
PARTIDA 3: Renta de equipo
CONCEPTO: 4
Descripción
Mantenimiento mayor

Cantidad: 2
Unidad: cajas
Unidad: servicios
Cantidad: 9
5.
NO. 6: CANTIDAD"""


def test_items_of_each_kind(spark):
    df = spark.createDataFrame([(1, CATALOGUE, False), (2, None, False), (3, "", False), (4, "12.\nBombas de agua", False), (5, "Cantidad Unidad\n12.\nBombas de agua", True)], "p int, t string, pen boolean")
    got = [tuple(r)[1:] for r in I.items(df, ["p"], "t", F.col("pen")).orderBy("p", "index").collect()]
    plain = [(i, k, n, d, None if q is None else float(q), u, a, b) for i, k, n, d, q, u, a, b, _ in got]
    assert plain == [
        (1, "BARE", "12", "Suministro de tubería de acero 4,5", None, "PZA", 2, 6),
        (2, "BARE", "13", "Bombas", 2.0, "LOTE", 7, 10),
        (3, "BARE", "14", "Válvulas tipo mariposa", None, None, 11, 13),
        (4, "ROW", "7", "Grúa de patio", 3.5, None, 14, 14),
        (5, "ROW", "9", "Tornillos varios", 2.0, None, 16, 16),
        (6, "ROW", "A-12", "Norma NOM-001", 2.0, None, 17, 17),
        (7, "INLINE", "3", "Renta de equipo", None, None, 18, 18),
        (8, "HEADING", "4", "Mantenimiento mayor Cantidad: 9 5.", 2.0, "SERVICIO", 19, 27),
    ]


def table_words(rows, cells=None, shift=0.0):
    """Words and cells of a table given as rows of texts; a cell's second half of words stands on a second line."""
    words, boxes, at, no = [], [], 0, 0
    for r, row in enumerate(rows):
        for c, text in enumerate(row):
            boxes.append((1, 1, r, c, c * 100.0, r * 30.0, c * 100.0 + 100, r * 30.0 + 30, True, text))
            parts = text.split()
            for k, w in enumerate(parts):
                low = k >= 2
                x, y = c * 100 + 5 + (k % 2) * 40 + shift, r * 30 + (12 if low else 2)
                words.append((1, no, w, at, at + len(w), float(x), float(y), x + 41.0, y + 11.0, r * 100 + c * 2 + low))
                at, no = at + len(w) + 1, no + 1
    return words, boxes


WORDS = "page long, no long, text string, start long, end long, x0 double, y0 double, x1 double, y1 double, line long"
CELLS = "page long, table long, row int, column int, x0 double, y0 double, x1 double, y1 double, ruled boolean, raw string"
HEAD = ["Partida", "Descripción", "Cantidad", "Unidad"]


def fields(df):
    return [(r.row, r.fields["item"], r.fields["description"], r.fields["quantity"], r.fields["unit"]) for r in df.orderBy("row").collect()]


def test_generated_tables_come_back(spark):
    rng = random.Random(2)
    body = [[str(k + 1), " ".join(rng.choice(["bomba", "válvula", "tubo"]) for _ in range(rng.randint(1, 4))), str(rng.randint(1, 90)), rng.choice(["pza.", "KG", "m2"])] for k in range(12)]
    odd = [["0", "cero", "1", "kg"], ["20", "sin unidad", "1", "cajas"], ["21", "¿cuál?", "1", "kg"], ["22", "capítulo ..... 7", "1", "kg"], ["23", "coma", "1,5", "kg"]]
    words, cells = table_words([HEAD, *body, *odd])
    want = [(k + 1, *row) for k, row in enumerate(body)]
    w, c = spark.createDataFrame(words, WORDS), spark.createDataFrame(cells, CELLS)
    found = L.ruled_tables(w, c)
    assert fields(found) == want
    text = " ".join(x[2] for x in words)
    for r in found.collect():
        for role, p in r.places.items():
            assert " ".join(text[a:b] for a, b in p.places) == r.fields[role]
    assert fields(L.standing_tables(w)) == want


@pytest.mark.parametrize("fault", ["missing", "twice", "open", "gap", "wide", "other words", "unknown heading", "same headings"])
def test_unsound_tables_are_none(spark, fault):
    head = HEAD if "heading" not in fault else ["Partida", "Descripción", "Cantidad", "Precio" if fault == "unknown heading" else "Quantity"]
    words, cells = table_words([head, ["1", "bomba", "2", "kg"], ["2", "tubo", "3", "kg"]])
    cells = [list(c) for c in cells]
    if fault == "missing":
        cells.pop(5)
    elif fault == "twice":
        cells.append(cells[5])
    elif fault == "open":
        cells[7][8] = False
    elif fault == "gap":
        for c in cells[4:8]:
            c[7] -= 1
    elif fault == "wide":
        cells[5][6] += 1
    elif fault == "other words":
        cells[9][9] = "tubos"
    assert fields(L.ruled_tables(spark.createDataFrame(words, WORDS), spark.createDataFrame([tuple(c) for c in cells], CELLS))) == []


def test_bands_of_ties_and_chains(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 3.0, 4.0), (1, 3.0, 4.0), (1, 9.0, 9.5), (2, 5.0, 6.0)], "p int, a double, b double")
    assert sorted(r.band for r in L.bands(df, ["p"], "a", "b", "band").where("p = 1").collect()) == [0, 0, 1, 1, 2]


def test_bands_of_a_batch_equal_those_of_windows(spark):
    rng = np.random.default_rng(3)
    table = np.sort(rng.integers(0, 20, 300))
    table = np.unique(table, return_inverse=True)[1]
    low = rng.integers(0, 60, 300).astype(float)
    high = low + rng.integers(0, 4, 300)
    df = spark.createDataFrame([(int(t), n, float(a), float(b)) for n, (t, a, b) in enumerate(zip(table, low, high, strict=True))], "t int, n int, a double, b double")
    assert [r.band for r in L.bands(df, ["t"], "a", "b", "band").orderBy("n").collect()] == L.sweep(table, low, high).tolist()


def test_batches_never_part_tables(monkeypatch):
    monkeypatch.setattr(L, "ROWS", 10)
    keys = [k for k, n in enumerate([3, 9, 1, 1, 40, 2, 2, 11, 1]) for _ in range(n)]
    for size in (1, 4, 7, 100):
        batches = [pa.RecordBatch.from_pydict({"page": keys[k : k + size], "n": list(range(k, min(k + size, len(keys))))}) for k in range(0, len(keys), size)]
        got = list(L.whole_tables(iter(batches), ["page"]))
        assert [n for t, _ in got for n in t["n"].to_pylist()] == list(range(len(keys)))
        for t, number in got:
            assert number.tolist() == (np.unique(t["page"].to_numpy(), return_inverse=True)[1]).tolist()
        ends = [(t["page"][0].as_py(), t["page"][-1].as_py()) for t, _ in got]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False)) and (size == 100 or len(got) > 2)


def test_rows_may_lack_columns_and_have_others(spark):
    words, _ = table_words([[*HEAD, "Marca"], ["1", "bomba azul marino", "2", "kg", "ACME"], ["2", "tubo", "3", "kg", ""], ["3", "tubo", "4", "kg", "ACME", "de más"], ["4", "¿tubo?", "4", "kg", "ACME"]])
    other = [(2, *w[1:]) for w in words if w[6] != 30.0 * 0 + 2 or w[5] < 300]
    found = L.standing_tables(spark.createDataFrame([*words, *other, (None, *words[0][1:])], WORDS)).orderBy("row").collect()
    assert [(r.page, r.row, r.fields) for r in found] == [(1, 1, {"item": "1", "description": "bomba azul marino", "quantity": "2", "unit": "kg", "brand": "ACME"}), (1, 3, {"item": "3", "description": "tubo", "quantity": "4", "unit": "kg", "brand": "ACME"})]


def loop(edges):
    """edges (weight, left, right): the loop that takes whatever is free."""
    lefts, rights, out = set(), set(), set()
    for _, a, b in sorted(edges):
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            out.add((a, b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_matches_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(1, 4), rng.randint(0, 25), rng.randint(0, 25)) for _ in range(150)] + [(1, 0, 0), (1, 0, 0)]
    df = spark.createDataFrame([*edges, (0, None, 3), (0, 3, None)], "w int, a int, b int")
    assert {tuple(r) for r in match.greedy_matches(df, "a", "b", [F.col("w")]).collect()} == loop(edges)
    assert match.greedy_matches(df.limit(0), "a", "b", [F.col("w")]).collect() == []


def test_ordered_matches_equal_the_loop(spark):
    e = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", 1), (4, None, 1)], "id int, k string, v int")
    f = spark.createDataFrame([(10, "y", 2), (11, "x", None), (12, None, 1), (13, "x", None), (14, "x", None)], "id int, k string, v int")
    got = {tuple(r) for r in match.ordered_matches(e, f, ["k", "v"], "id").collect()}
    assert got == {("x", None, 1, 11), ("x", None, 2, 13), ("x", None, None, 14), ("y", 1, 3, None), ("y", 2, None, 10), (None, 1, 4, 12)}


BLOCKS = {
    "Partida|Descripción|Cantidad|Unidad\n1|Tubo|2|kg\n\n2|Tubo|2|kg": [("1", {"description": "Tubo", "quantity": "2", "unit": "kg"}, "SUPPORTED")],
    "item\tDescripcion\tquantity\tunit\tmodel\n1\tPipe\t2\tkg\tX-1\nnote\n2\tPipe\t2\tkg\tX-2": [("1", {"description": "Pipe", "quantity": "2", "unit": "kg", "model": "X-1"}, "SUPPORTED")],
    "Partida|Descripción|Cantidad|Cantidad\n1|Tubo|2|2": [],
    "Partida|Descripción|Cantidad|Unidad|Color\n1|Tubo|2|kg|rojo": [],
    "PARTIDA 7: Entrega de planos\n\tfinales \nModelo: M1 \r\nCantidad: 3\nfin\n  suelto": [("7", {"description": "Entrega de planos finales", "model": "M1", "quantity": "3"}, "SUPPORTED")],
    "PARTIDA 7\nServicio de limpieza | marca : A | nada\nPARTIDA 8: entregar todo": [("7", {"description": "Servicio de limpieza", "brand": "A"}, "SUPPORTED"), ("8", {"description": "entregar todo"}, "SUPPORTED")],
    "PARTIDA 7\nPartida|Descripción|Cantidad|Unidad\n1|Tubo|2|kg": [],
    "PARTIDA 7": [],
    "PARTIDA 7: Suministro\nUnidad: kg\nUnidad: m": [("7", {"description": "Suministro", "unit": "kg m"}, "AMBIGUOUS")],
    "PARTIDA 7: Suministro de válvulas ..... 12": [],
    "": [],
    "  \n|\t|\n": [],
}


def test_labelled_items_and_their_places(spark):
    pages = [*enumerate(BLOCKS), (99, None), (98, "PARTIDA 1: Suministrar\n" + "  más\n" * 500)]
    found = labelled.structured_blocks(spark.createDataFrame(pages, "p int, t string"), ["p"], "t").orderBy("p", "occurrence").collect()
    texts = dict(pages)
    for r in found:
        for role, places in r.places.items():
            said = " ".join(texts[r.p][a:b] for a, b in places)
            assert role == "item" or role.startswith("header_") or said == r.fields[role]
    told = {}
    for r in found:
        told.setdefault(r.p, []).append((r.item, {k: " ".join(v.split()) for k, v in r.fields.items()}, r.state))
    assert told.pop(98)[0][1]["description"] == "Suministrar" + " más" * 500
    assert {p: told.get(p, []) for p in range(len(BLOCKS))} == {p: [(i, {k: " ".join(v.split()) for k, v in f.items()}, s) for i, f, s in want] for p, want in enumerate(BLOCKS.values())}
