"""The character model against a plain implementation, and its decisions."""

import collections
import math

import numpy as np

import messy
from tillscope.llm import kneser_ney as K
from tillscope.llm import queries


def plain_model(texts):
    """P(symbol | four symbols before) by the textbook formulas, recursively."""
    n = {K.ORDER: collections.Counter()}
    for t in texts:
        s = [K.BEGIN] * 4 + K.symbols(t).tolist() + [K.END]
        for i in range(len(s) - 4):
            n[5][tuple(s[i:i + 5])] += 1
    for m in range(4, 0, -1):
        n[m] = collections.Counter(g[1:] for g in n[m + 1])
    discount, context = {}, {}
    for m, counts in n.items():
        c = [sum(v == k for v in counts.values()) for k in range(1, 5)]
        if not c[0] or not c[1]:
            discount[m] = (0.5, 0.5, 0.5)
        else:
            y = c[0] / (c[0] + 2 * c[1])
            raw = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else k / 2 for k in (1, 2, 3)]
            discount[m] = tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3)))
        context[m] = collections.defaultdict(list)
        for g, v in counts.items():
            context[m][g[:-1]].append(v)

    def p(g):
        if not g:
            return 1 / K.SYMBOLS
        m = len(g)
        own = context[m].get(g[:-1])
        if not own:
            return p(g[1:])
        d = lambda v: discount[m][min(v, 3) - 1]
        v = n[m][g]
        return ((v - d(v)) / sum(own) if v else 0.0) + sum(map(d, own)) / sum(own) * p(g[1:])

    return p


def plain_perplexity(p, text):
    s = [K.BEGIN] * 4 + K.symbols(text).tolist() + [K.END]
    return math.exp(-sum(math.log(p(tuple(s[i:i + 5]))) for i in range(len(s) - 4)) / (len(s) - 4))


def test_perplexities_equal_the_plain_model(spark):
    rows = [(i, t) for i, t in enumerate(messy.texts()) if len(t or "") < 5000] + [(None, "no id"), (5, "again five")]
    trusted = [i for i in range(0, 30) if i != 2]
    import zlib

    learned = {i for i in trusted if zlib.crc32(str(i).encode()) % K.HELD_OUT}
    p = plain_model([t or "" for i, t in rows if i in learned])
    got = K.classify(messy.documents(spark, rows), spark.createDataFrame([(i,) for i in trusted], "doc_id long"))
    assert got.columns == ["doc_id", "lang", "n_symbols", "perplexity", "threshold", "kept"]
    have = sorted((repr(r.doc_id), r.n_symbols, round(r.perplexity, 6)) for r in got.collect())
    want = sorted((repr(i), len(K.symbols(t or "")) + 1, round(plain_perplexity(p, t or ""), 6)) for i, t in rows)
    assert have == want


def test_probabilities_sum_to_one():
    p = plain_model(["some text here", "some more", "text"])
    for before in [(1, 1, 1, 1), tuple(map(ord, "some")), (9, 9, 9, 9)]:
        assert abs(sum(p((*before, s)) for s in range(K.SYMBOLS)) - 1) < 1e-9


def test_no_trusted_text_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long")
    got = K.classify(messy.documents(spark), none)
    assert got.where("not kept or threshold is not null").count() == 0
    assert abs(got.first().perplexity - K.SYMBOLS) < 1e-6
    assert K.classify(messy.nothing(spark), none).count() == 0


def test_decisions_on_labelled_rows(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_kneser_ney(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    good, bad = got.where("quality = 1 and toxic = 0"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count() > 0
    assert bad.where("not kept").count() >= 0.6 * bad.count() > 0
    assert queries.op1_kneser_ney(spark, d).count() == 1000


def test_a_long_text_in_blocks_equals_the_whole(monkeypatch):
    text = messy.words(400, 3)
    whole = np.concatenate(list(K.text_runs(text)))
    monkeypatch.setattr(K, "BLOCK", 7)
    assert np.array_equal(np.concatenate(list(K.text_runs(text))), whole) and len(whole) == len(text) + 1


def test_thresholds_are_by_language(spark):
    rows = [(i, messy.words(20, i)) for i in range(300)]
    docs = messy.documents(spark, rows)
    got = K.classify(docs, spark.range(300).toDF("doc_id"))
    limits = {(r.lang, r.threshold) for r in got.collect()}
    assert len({lang for lang, _ in limits}) == len(limits) == 2
