"""The pipeline's stages, one after the other, against brute force."""

import hashlib
from collections import Counter

import pytest

pytest.importorskip("ledgerloom.llm")
import corpus_pipeline  # noqa: E402
from ledgerloom.llm import bpe  # noqa: E402
from test_documents import brute_components, brute_kept, brute_print, brute_targets, words_of  # noqa: E402


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars", "extra").collect()]


def test_stages_match_brute_force(spark, sf):
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(-1, None, "en", "src0", 0), (-2, "12 34 !", "en", "src0", 7), (None, "the and of this that with", "en", None, 25), (-4, "the and of this that with him", None, None, 30)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.where("doc_id = 3")).selectExpr("*", "'e' AS extra")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "simhash_near_dedup", "substring_dedup", "source_mix", "byte_bpe"]

    first = steps["language_id"](spark, docs, sf).persist()
    assert first.columns == docs.columns
    assert Counter(rows_of(first)) == Counter(r for r in rows_of(docs) if r[0] not in (-1, -2))

    second = steps["simhash_near_dedup"](spark, first, sf).persist()
    before = rows_of(first)
    prints = {r[0]: brute_print(r[1]) for r in before if r[0] is not None}
    roots = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = {r for r in before if r[0] is None or roots[r[0]] == r[0]}
    assert sorted(rows_of(second), key=str) == sorted(want, key=str)

    third = steps["substring_dedup"](spark, second, sf).persist()
    whole = {r[0]: r for r in rows_of(second)}
    want = []
    for i, n, gone, kept in brute_kept([r[:2] for r in rows_of(second)]):
        r = whole[i]
        if not gone:
            want.append(r)
        elif gone < n:
            want.append((i, kept, r[2], r[3], len(kept), r[5]))
    assert sorted(rows_of(third), key=str) == sorted(want, key=str)

    fourth = steps["source_mix"](spark, third, sf).persist()
    before, after = rows_of(third), Counter(rows_of(fourth))
    assert set(after) <= set(before) and max(after.values()) <= 2
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        n = len(words_of(r[1]))
        sizes[r[3]] += n
        taken[r[3]] += n * after[r]
        largest[r[3]] = max(largest[r[3]], n)
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= 2 * largest[source]

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda t: hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in plain.encode_ordinary(t))).hexdigest()
    told = steps["byte_bpe"](spark, fourth, sf)
    assert Counter((r.doc_id, r.ids_sha256) for r in told.collect()) == Counter({(r[0], digest(r[1])): n for r, n in after.items()})


NAMES = "score lang_pred held_out strange kept n_words n_removed size target copies taken source_size fp component_id group id mark doc class tie __row __fp __extra_0".split()


def test_clashing_columns_pass_through(spark, sf):
    """Every name that an operator adds, as a column of the input: it comes out of the first four stages as it went in."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mine = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in NAMES])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, mine, sf)
        assert out.columns == mine.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in NAMES), name
    assert corpus_pipeline.STAGES[4][1](spark, mine, sf).count() == mine.count()


def test_foreign_and_junk_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = ["zzqx", "これは日本語の文章です。とても短いです。", "Это короткий русский текст, который не должен пройти.", "xkjq vvzw qqpt zkxv wqjx", "To jest zwykłe polskie zdanie, które powinno odpaść.", "中文" * 40, "123 456"]
    short = ["The of and in.", "La é le de de.", "Einü der den und."]
    more = [(100_000 + k, t, None, "src0", len(t)) for k, t in enumerate(odd)] + [(200_000 + k, t, None, "src0", len(t)) for k, t in enumerate(short)]
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), "").select("doc_id").collect()}
    clean = {r.doc_id for r in docs.select("doc_id").collect()} | {200_000 + k for k in range(len(short))}
    assert kept == clean


def test_different_texts_under_one_id_are_documents_of_their_own(spark, sf):
    """Id 5 has a near copy of 3's text, a repeated text of its own, and a text that 9 copies: none but near copies and repeats go."""
    one, two, three = (" ".join(f"{w}{k}" for k in range(200)) for w in ("ab", "cd", "ef"))
    rows = [(3, one), (5, one), (5, two), (5, two), (5, three), (9, three), (7, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(3, one), (5, two), (5, three)]


def test_run_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


FOREIGN = {
    "Polish": "Wczoraj poszliśmy do lasu, żeby zbierać grzyby, ale nie znaleźliśmy niczego ciekawego oprócz starego, zardzewiałego roweru pod drzewem.",
    "Dutch": "Gisteren zijn we naar het bos gegaan om paddenstoelen te zoeken, maar we hebben niets gevonden behalve een oude fiets onder een boom.",
    "Portuguese": "Ontem fomos à floresta para procurar cogumelos, mas não encontramos nada de interessante além de uma bicicleta velha e enferrujada.",
    "Italian": "Ieri siamo andati nel bosco a cercare funghi, ma non abbiamo trovato niente di interessante tranne una vecchia bicicletta arrugginita.",
    "Swedish": "Igår gick vi till skogen för att plocka svamp, men vi hittade inget intressant förutom en gammal rostig cykel under ett träd.",
    "Turkish": "Dün mantar toplamak için ormana gittik ama ağacın altındaki eski paslı bir bisikletten başka ilginç bir şey bulamadık.",
    "Finnish": "Eilen menimme metsään keräämään sieniä, mutta emme löytäneet mitään kiinnostavaa paitsi vanhan ruosteisen polkupyörän puun alta.",
    "code": 'for (int i = 0; i < n; ++i) { sum += a[i] * b[i]; }\nreturn {"items": [{"name": "foo", "qty": 3}, {"name": "bar", "qty": null}], "total": sum};',
}


def test_other_languages_and_code_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(10**9 + k, text, None, "src0", len(text)) for k, text in enumerate(FOREIGN.values())]
    short = [(2 * 10**9 + k, text, None, "src0", len(text)) for k, text in enumerate(("ok", "the", "la de"))]
    kept = corpus_pipeline.keep_known_languages(spark, docs.unionByName(spark.createDataFrame(odd + short, docs.schema)), "")
    got = [r.doc_id for r in kept.select("doc_id").collect()]
    assert [i for i in got if 10**9 <= i < 2 * 10**9] == []
    assert len([i for i in got if i < 10**9]) == docs.count()
    assert len([i for i in got if i >= 2 * 10**9]) >= 2  # a few letters can't tell: they stay unless the prediction is hardly above chance
