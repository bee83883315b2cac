"""Hyperdimensional language profiles: held-out accuracy, edge cases, a brute-force vector."""

import numpy as np
from pyspark.sql import functions as F

import messy
from tillscope.llm import language_id as L
from tillscope.llm import queries


def test_vector_equals_brute_force():
    vectors, text = L.Vectors(64), "Ab, c d"
    codes = [32, ord("a"), ord("b"), 32, ord("c"), 32, ord("d"), 32]
    want = np.zeros(64)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        want += np.roll(vectors.letter(a), 2) * np.roll(vectors.letter(b), 1) * vectors.letter(c)
    assert np.array_equal(L.text_vectors([text], vectors)[0], want)
    grams, counts = np.unique(L.ngrams(L.letters(text)), return_counts=True)
    assert np.array_equal(vectors.weighted_sum(grams, counts), want)


def test_a_small_cache_changes_nothing(monkeypatch):
    texts = [t or "" for t in messy.texts()]
    want = L.text_vectors(texts, L.Vectors(32))
    monkeypatch.setattr(L, "KEPT_NGRAMS", 50)
    assert np.array_equal(L.text_vectors(texts, L.Vectors(32)), want)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op3_language_id(spark, d).join(
        spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    part = got.where("held_out")
    assert part.where(F.col("lang") == F.col("lang_pred")).count() >= 0.97 * part.count() > 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_the_query_never_learns_from_held_out_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "a/documents.parquet"))
    wrong = docs.withColumn("lang", F.when(L.held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    wrong.write.parquet(str(tmp_path / "b/documents.parquet"))
    a, b = (sorted(map(tuple, queries.op3_language_id(spark, str(tmp_path / x)).collect())) for x in "ab")
    assert a == b and len(a) == docs.count()


def test_edge_cases(spark):
    docs = messy.documents(spark)
    model = L.train(docs)
    assert list(model) == ["en"]
    got = L.predict(docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == docs.count()
    by = {(r.doc_id, r.lang_pred) for r in got.collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (7, "und"), (3, "en"), (None, "en")} <= by
    assert L.predict(docs, {}).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert L.train(messy.nothing(spark)) == {} and L.predict(messy.nothing(spark), model).count() == 0


def test_ties_go_to_the_first_language(spark):
    v = np.ones(L.DIMENSIONS) / np.sqrt(L.DIMENSIONS)
    got = L.predict(messy.documents(spark, [(1, "some text")]), {"aa": v, "bb": v}).first()
    assert got.lang_pred in ("aa",) or got.score == 0


def test_long_texts_are_taken_whole():
    vectors = L.Vectors(64)
    head, tail = "abc " * 60_000, "xyz " * 60_000
    whole = L.text_vectors([head + tail], vectors)[0]
    parts = L.text_vectors([head, tail], vectors).sum(axis=0)
    assert np.abs(whole - parts).max() <= 8 and np.abs(whole).sum() > 0


def test_cuts_lose_and_add_no_ngram(monkeypatch):
    texts = [t or "" for t in messy.texts()] + ["ΟΔΟΣ ΣΑΣ", "a", " - a - b", "x" * 50 + "  y"]
    want = [np.sort(L.ngrams(L.letters(t))) for t in texts]
    whole = L.text_vectors(texts, L.Vectors(32))
    for block in (1, 2, 7, 100):
        monkeypatch.setattr(L, "BLOCK", block)
        for text, grams in zip(texts, want):
            if len(text) < 2000 or block > 2:
                assert np.array_equal(np.sort(np.concatenate(list(L.text_ngrams(text)))), grams)
    assert np.array_equal(L.text_vectors(texts, L.Vectors(32)), whole)
