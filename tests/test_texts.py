"""Spans, effects and candidates against plain loops and the cases that the rules are made for."""

import random
import re

import pytest
from ledgerloom.functions import requirements as R
from ledgerloom.operators import discovery as D
from ledgerloom.operators import spans as S
from ledgerloom.plans import requirements as P
from pyspark.sql import functions as F


def tidy(x):
    return re.sub(r"[ \t\n\r\f\v]+", " ", x).strip(" ")


def plain(x):
    return tidy(x.lower().translate(str.maketrans("áéíóúüñ", "aeiouun")))


def garbled(line):
    lone = sum(len(w) == 1 and w in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZáéíóúÁÉÍÓÚ" for w in re.split(r"\W+", line))
    letters = len(re.findall("[A-Za-zÁÉÍÓÚáéíóúÑñ]", line))
    return len(line) <= 3 or (lone >= 4 and letters <= 18) or (letters == 0 and len(line) < 12)


def folded(page):
    """Blocks as lists of (place, raw line), by a state machine: an open block, and a heading that waits for its list."""
    blocks, open_, waiting, at = [], [], None, 0
    obliges = lambda raw: any(re.search(p, plain(raw)) for p in (*R.OBLIGING, R.IMPERATIVE_LATER))

    def close():
        if open_:
            blocks.append(list(open_))
            open_.clear()

    for raw in re.split(r"[\r\n]", page):
        here, at, line = (at, raw), at + len(raw) + 1, tidy(raw)
        if not line:
            close()
            waiting = None
        elif garbled(line):
            pass
        elif re.search(R.CHECKLIST, plain(raw)) and line.endswith(":"):
            close()
            waiting = here
        elif waiting:
            open_ += [waiting, here]
            waiting = None
        else:
            if re.search(S.BULLET, line) or (obliges(raw) and any(obliges(x) for _, x in open_)):
                close()
            open_.append(here)
    close()
    return blocks


def plain_spans(page):
    for block in folded(page):
        pieces = [(at + m.start(), m.group()) for at, raw in block for m in re.finditer(S.PIECE[4:], raw, re.S)]
        groups = []
        for at, piece in pieces:
            if groups and not re.search("[.;]$", tidy(groups[-1][-1][1])):
                groups[-1].append((at, piece))
            else:
                groups.append([(at, piece)])
        text = lambda g: " ".join(tidy(p) for _, p in g)
        useful = [g for g in groups if len(text(g)) >= 20]
        if len(text(pieces)) >= 20:
            yield from (text(g) for g in (useful if len(useful) > 1 else [pieces]))


def test_spans_equal_a_fold_and_stand_where_they_say(spark):
    rng = random.Random(1)
    pages = [(i, "\n".join(rng.choice([*P.LINES, "", "Nada que pedir en este renglón"]).replace("{q}", str(rng.randint(1, 99))) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    pages += [(90, None), (91, ""), (92, " \r\n \r\n"), (93, "Requisitos y criterios:"), (94, "word. " * 3000), (95, "\n".join(["El licitante deberá presentar una carta"] * 500))]
    df = spark.createDataFrame(pages, "p long, page string").selectExpr("*", "1 AS block", "'x' AS span")
    found = S.spans(df.select("p", "page"), ["p"], "page").collect()
    by_page, texts = {}, dict(pages)
    for r in sorted(found, key=lambda r: (r.p, r.places[0].start)):
        by_page.setdefault(r.p, []).append(r.text)
        assert " ".join(tidy(texts[r.p][a:b]) for a, b in r.places) == r.text
    for p, page in pages:
        assert by_page.get(p, []) == list(plain_spans(page or "")), p
    assert len(by_page[95]) == 500


def test_modality_is_the_verb_asked_for(spark):
    said = [("el licitante en su oferta presentará carta", "presentara"), ("el licitante deberá firmar", "debera"), ("formato: anexar copia", "anexar"), ("no se aceptarán ofertas", "no se aceptaran")]
    rows = spark.createDataFrame(said, "t string, want string").select("want", R.modality(R.obligation(S.T.plain(F.col("t")))["words"]).alias("got"))
    assert [r.got for r in rows.collect()] == [w for _, w in said]


EFFECTS = {
    # text: (kind, scope, reference, locator, target, diagnostic, third, review)
    "Se modifica el numeral 4.2 del Anexo B.": ("AMENDS", "PARTIAL", "Anexo B", "numeral 4.2", 2, None, False, False),
    "Se sustituye en su totalidad el Anexo B por el Formato 9": ("SUPERSEDES", "DOCUMENT_WIDE", "Anexo B", None, 2, None, True, True),
    "QUEDA SIN EFECTO la convocatoria": ("REVOKES", "UNRESOLVED", "convocatoria", None, None, "UNRESOLVED_TARGET_DOCUMENT", False, True),
    "Se aclara la página 3 de las Bases": ("CLARIFIES", "PARTIAL", "Bases", "página 3", None, "AMBIGUOUS_TARGET_DOCUMENT", False, True),
    "Se corrige el inciso c) del Anexo A": ("CORRECTS", "PARTIAL", "Anexo A", "inciso c", None, "SAME_DOCUMENT_TARGET", False, True),
    "Se adiciona lo siguiente": ("SUPPLEMENTS", None, None, None, None, "MISSING_TARGET_CONTEXT", False, True),
    "Se adiciona la partida 7": ("SUPPLEMENTS", "PARTIAL", None, "partida 7", None, None, False, False),
    "El numeral 4 del Anexo B sigue igual": None,
}


def test_effects_of_each_kind(spark):
    docs = spark.createDataFrame([(1, 1, "Anexo A.pdf", None), (1, 2, "anexo b.pdf", "x/Anexo-B.docx"), (1, 3, "Bases de Licitacion.pdf", None), (1, 4, "bases de licitacion (2).pdf", ""), (2, 5, "Convocatoria.pdf", None)], "group long, document long, filename string, path string")
    pages = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(EFFECTS)] + [(1, 1, 90, None), (1, 1, 91, "")], "group long, document long, page long, text string")
    got = {r.page: tuple(r)[5:13] for r in D.effects_in_texts(pages, "page", "text", docs).collect()}
    assert got == {k: (*v[:7], v[7]) for k, v in enumerate(EFFECTS.values()) if v}


def test_effects_are_numbered_within_a_page(spark):
    docs = spark.createDataFrame([], "group long, document long, filename string, path string")
    pages = spark.createDataFrame([(1, 1, 1, "Se revoca la tabla 1. Se aclara todo; Se modifica la tabla 2:\nSe corrigen la tabla 3 ")], "group long, document long, page long, text string")
    assert [(r.kind, r["index"]) for r in D.effects_in_texts(pages, "page", "text", docs).orderBy("at").collect()] == [("REVOKES", 0), ("CLARIFIES", None), ("AMENDS", 1), ("CORRECTS", 2)]


def test_candidates_stand_where_they_say_and_choices_are_checked(spark):
    text = "Todo sigue igual. El plazo es 3.5 meses desde 2024-01-05! Se modifica el numeral 4 del Anexo B y el NUMERAL  4; ver 01/02/24.  Nada más"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "...   ")], "id long, text string")
    spans, keys = D.offered_spans(df, ["id"], "text"), ["id"]
    rows = {(r.id, r["rank"]): r for r in spans.collect()}
    assert all(text[r.start : r.end] == r.span for (i, _), r in rows.items() if i == 1)
    assert [rows[1, k].span for k in (1, 2, 4)] == [" Se modifica el numeral 4 del Anexo B y el NUMERAL  4; ver 01/02/24.", "Todo sigue igual.", "  Nada más"] and (2, 1) not in rows
    offered = D.candidates(spans, keys)
    told = [(r.kind, r.number, r["rank"], r.raw) for r in offered.orderBy("kind", "number").collect() if r.id == 1]
    assert told == [("DATE", 1, 1, "01/02/24"), ("DATE", 2, 3, "2024-01-05"), ("LOCATOR", 1, 1, "numeral 4"), ("TARGET", 1, 1, "Anexo B"), ("TARGET", 2, 1, "numeral 4")]
    assert all(text[r.start : r.end] == r.raw for r in offered.collect() if r.id == 1)
    choices = [(1, 1, 1, 1, 1, None, None, "01/02/24"), (1, 2, 9, 1, None, None, None, None), (1, 3, 2, 1, None, None, None, None), (1, 4, 1, 7, None, None, None, None), (1, 5, 1, None, 1, "numeral 5", None, None), (1, 6, 1, None, None, "del Anexo C", None, None), (1, 7, 1, None, None, "Anexo B y", 1, None)]
    df = spark.createDataFrame(choices, "id long, choice int, rank int, target int, locator int, locator_raw string, date int, date_raw string")
    got = {r.choice: (r.error, r.locator_raw, r.date_raw) for r in D.selected(df, spans, offered, keys).collect()}
    assert got == {1: (None, "numeral 4", "01/02/24"), 2: ("UNKNOWN_SPAN", None, None), 3: ("TARGET_OF_ANOTHER_SPAN", None, None), 4: ("UNKNOWN_TARGET", None, None), 5: ("LOCATOR_WORDING_DIFFERS", None, None), 6: ("LOCATOR_NOT_GROUNDED", None, None), 7: (None, "Anexo B y", "01/02/24")}


@pytest.mark.parametrize(
    ("value", "excerpt", "source", "want"),
    [("10 m", "son 10  M de", "Son 10 m\nde tubo", "GROUNDED"), (None, "son", "Son", "GROUNDED"), ("11", "son 10", "son 10", "VALUE_NOT_IN_EXCERPT"), ("1", "no", "si", "EXCERPT_NOT_IN_SOURCE"), ("1", " ", "si", "NO_EXCERPT"), ("1", "a", None, "EXCERPT_NOT_IN_SOURCE")],
)
def test_grounding(spark, value, excerpt, source, want):
    df = spark.createDataFrame([(value, excerpt, source)], "v string, e string, s string")
    assert df.select(D.grounded(F.col("v"), F.col("e"), F.col("s"))).first()[0] == want


def test_one_pattern_of_terms_finds_what_each_would(spark):
    from ledgerloom.functions import text as X
    from ledgerloom.operators import doctypes

    rng, every = random.Random(3), [t for terms in doctypes.SIGNALS.values() for t in terms]
    one = X.any_literal(tuple(every))
    assert len(one) < len("|".join(sorted({re.escape(t) for t in every}))) * 0.75
    cut = [t[: rng.randint(1, len(t))] + rng.choice(["", " x", "z"]) for t in every for _ in range(5)] + every
    for said in [*cut, *(a + b for a, b in zip(cut, cut[7:], strict=False))]:
        assert bool(re.search(one, said)) == any(t in said for t in every)
    assert re.fullmatch(X.any_literal(("a.b", "a.c", "b")), "a.c") and not re.search(X.any_literal(("a.b", "a.c")), "axb")


def test_one_pattern_of_wordings_finds_what_each_would(spark):
    from ledgerloom.functions import text as X

    one, words = X.any_pattern((*R.OBLIGING, R.IMPERATIVE_LATER)), "no se aceptara deberan el licitante presentara . ; : firmar xdebera sera requisito causa de desechamiento tendra que propuesta".split()
    rng = random.Random(4)
    for _ in range(3000):
        said = " ".join(rng.choices(words, k=rng.randint(1, 6)))
        assert bool(re.search(one, said)) == any(re.search(p, said) for p in (*R.OBLIGING, R.IMPERATIVE_LATER))


def test_readable_and_quality_tell_what_counting_each_character_tells(spark):
    from ledgerloom.functions import text as X

    rng = random.Random(5)
    texts = [None, "", "  \n ", "uno dos tres cuatro", "uno dos tres", "a a a a b", "ñ é \U0001d49c " * 60 + "fin", "x" * 399 + "yz b c", "1 2 3 uno dos tres cuatro" + " 9" * 40]
    texts += ["".join(rng.choices("ab c\té1|¢Ñ\n. [", k=rng.randint(0, 300))) for _ in range(300)] + [" ".join(rng.choices(["uno", "dos", "tres", "y"], k=200)) for _ in range(5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    old = (F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(\p{L}+)"), F.lit(1)))) >= 4) & (F.regexp_count(t, F.lit(r"\p{L}")) >= F.regexp_count(t, F.lit(r"\S")) * 0.45) & ~t.rlike("[�\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]")
    compact = F.trim(F.regexp_replace(t, r"\s+", " "))
    lone = F.size(F.filter(F.split(F.substring(compact, 1, R.LOOKED_AT), r"[^\p{L}\p{N}_]+"), lambda x: x.rlike(R.LONE)))
    counted = F.struct(F.regexp_count(compact, F.lit(R.BAD_SIGNS)), lone, -F.regexp_count(compact, F.lit(R.LETTERS)))
    lines = F.regexp_replace(t, "\n", "")
    junk = (F.length(lines) <= S.TINY) | ((F.size(F.filter(F.split(lines, r"[^\p{L}\p{N}_]+"), lambda x: x.rlike(S.LONE))) >= S.MANY_LONE) & (F.regexp_count(lines, F.lit(S.LETTERS)) <= S.FEW_LETTERS)) | ((F.regexp_count(lines, F.lit(S.LETTERS)) == 0) & (F.length(lines) < S.SHORT_SIGNS))
    q = R.text_quality(t, t)
    out = df.select("i", X.readable(t).alias("a"), old.alias("b"), F.struct(q["signs"], q["lone"], q["letters"]).alias("c"), counted.alias("d"), S.garbled(lines).alias("e"), junk.alias("f"), X.without_accents(t).alias("g"), F.translate(t, X.ACCENTED, X.PLAIN).alias("h"))
    for r in out.collect():
        assert r.a == r.b and tuple(r.c) == tuple(r.d) and r.e == r.f and r.g == r.h, texts[r.i]
