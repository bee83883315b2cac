"""The pipeline's stages against brute force, each on its own input."""

import random

import pytest

import corpus_pipeline
import messy
from test_simhash import brute as simhash_brute
from test_suffix_dedup import gone
from test_tokens import check_packing
from tillscope.llm import language_id

DIR = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def plain(df):
    return sorted(((r[0], r[1]) for r in df.collect()), key=repr)


def without(rows, dropped):
    return sorted((r for i, r in enumerate(rows) if i not in dropped), key=repr)


@pytest.mark.parametrize("source", ["given", "messy"])
def test_each_stage(spark, source):
    docs = spark.read.parquet(f"{DIR}/documents.parquet") if source == "given" else messy.documents(spark)
    columns = docs.columns
    rows = [(r[0], r[1]) for r in docs.collect()]

    found = STAGE["language_id"](spark, docs, DIR)
    assert found.columns == columns
    bad = {i for i, (_, t) in enumerate(rows) if not any(c.isalpha() for c in t or "")}
    assert plain(found) == without(rows, bad)

    kept = STAGE["exact_dedup"](spark, docs, DIR)
    assert kept.columns == columns
    # one row of each text: the largest id, a null one only if there is no other
    best = {}
    for d, t in rows:
        if (t or "") not in best or (d is not None and (best[t or ""] is None or d > best[t or ""])):
            best[t or ""] = d
    assert sorted(((d, t or "") for d, t in plain(kept)), key=repr) == sorted(((d, t) for t, d in best.items()), key=repr)

    near = STAGE["simhash_near_dedup"](spark, docs, DIR)
    assert near.columns == columns
    # rows by number, so that repeated and null ids have classes of their own
    classes = {}
    for i, _, c in simhash_brute([(i, t) for i, (_, t) in enumerate(rows)]):
        classes.setdefault(c, []).append(rows[i])
    firsts = {c: min((d for d, _ in m if d is not None), default=None) for c, m in classes.items()}
    stay = plain(near)
    assert len(stay) == len(classes) and sorted((d for d, _ in stay), key=repr) == sorted(firsts.values(), key=repr)
    assert all(any((firsts[c], t) in m and firsts[c] == d for c, m in classes.items()) for d, t in stay)

    cut = STAGE["suffix_dedup"](spark, docs, DIR)
    assert cut.columns == columns
    want = []
    for (d, t), flags in zip(rows, gone([(t or "").encode() for _, t in rows], corpus_pipeline.REPEAT_BYTES)):
        left = bytes(b for b, f in zip((t or "").encode(), flags) if not f).decode("utf-8", "ignore")
        want.append((d, t if not flags.any() else left))
    assert plain(cut) == sorted(want, key=repr)
    at = columns.index("n_chars")
    assert all(r[at] == len(r[1] or "") for r in cut.collect())

    pieces = STAGE["packing"](spark, docs, DIR).collect()
    check_packing([(d, t or "") for d, t in rows], pieces, 2048, 1)


def test_planted_passages_of_over_fifty_words_go(spark):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(
        "lang = 'en'").orderBy("doc_id").collect()]
    pool, r = " ".join(given).split(), random.Random(51)
    stock, used = sorted(set(pool)), []
    some = lambda n: " ".join(r.choice(stock) for _ in range(n))
    docs = {i: some(r.randrange(80, 400)) for i in range(200)}
    clean = {i: some(r.randrange(80, 400)) for i in range(200, 400)}
    before = dict(docs)
    for n in range(100):
        passage = some(51 + n % 50)
        used.append(passage)
        for i in (n, n + 100):
            at = docs[i].split()
            k = r.randrange(len(at))
            docs[i] = " ".join([*at[:k], passage, *at[k:]])
    rows = [(i, t) for i, t in (docs | clean).items()]
    out = {r[0]: r[1] for r in STAGE["suffix_dedup"](spark, messy.documents(spark, rows), DIR).collect()}
    caught = sum(used[n] not in out[i] and len(out[i]) <= len(before[i]) + 20 for n in range(100) for i in (n, n + 100))
    assert caught >= 0.95 * 200
    assert sum(out[i] == t for i, t in clean.items()) >= 0.98 * 200


def test_empty_documents(spark):
    none = messy.nothing(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, DIR)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == none.columns


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "suffix_dedup", "packing"]
    assert language_id.UNKNOWN == "und"
