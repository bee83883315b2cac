"""Repeated 400-byte strings against brute force, in memory and as Spark jobs."""

import collections
import hashlib
import random

import numpy as np
import pytest

import messy
from tillscope.llm import queries
from tillscope.llm import suffix_dedup as S

LENGTH = S.LENGTH


def gone(bodies, length=LENGTH):
    seen = collections.Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        flags = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                flags[i:i + length] = True
        out.append(flags)
    return out


def brute(rows):
    out = []
    bodies = [t.encode() for _, t in rows]
    for (d, _), b, flags in zip(rows, bodies, gone(bodies)):
        kept = np.frombuffer(b, np.uint8)[~flags].tobytes()
        out.append((d, len(b), int(flags.sum()), len(S.runs(flags)[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n=60):
    r = random.Random(seed)
    letters = "abcdé "
    some = lambda k: "".join(r.choice(letters) for _ in range(k))
    base, passage, short = [some(r.randrange(2500)) for _ in range(12)], some(700), some(401)
    out = list(base)
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.randrange(4)):
            if t:
                t[r.randrange(len(t))] = r.choice("XYZ\0")
        out.append("".join(t))
    out += [some(r.randrange(200)) + passage + some(r.randrange(200)) for _ in range(12)]
    out += [some(20) + short + some(20) for _ in range(4)] + ["ab" * 1000, "x" * 900, some(37) * 40]
    return out


def test_edge_cases(spark):
    df = S.remove_repeats(messy.documents(spark))
    assert got(df) == brute(messy.rows(spark))


@pytest.mark.parametrize("hot", [S.HOT_BYTES, 4000, 0])
def test_corpus_with_hot_passages(spark, hot):
    rows = list(enumerate(corpus(3)))
    assert got(S.remove_repeats(messy.documents(spark, rows), hot_bytes=hot)) == brute(rows)


def test_a_third_of_the_rows_are_copies_and_no_repeats(spark):
    rows = [(i, messy.words(90, 7) if i % 3 == 0 else messy.words(90, 100 + i)) for i in range(90)]
    assert got(S.remove_repeats(messy.documents(spark, rows))) == brute(rows)


def test_empty_table_and_short_texts(spark):
    assert S.remove_repeats(messy.nothing(spark)).count() == 0
    rows = [(1, "short"), (2, "short"), (3, "")]
    assert got(S.remove_repeats(messy.documents(spark, rows))) == brute(rows)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(queries.op9_suffix_dedup(spark, d)) == brute(rows)


def test_texts_without_repeats_keep_all_columns(spark):
    rows = [(1, "é own " + messy.words(90, 1)), (2, messy.words(90, 1) + "ü"), (None, None), (4, "own")]
    out = S.without_repeats(messy.documents(spark, rows), id_col="doc_id")
    assert out.columns == messy.DOCUMENTS
    texts = {r[0]: r[1] for r in out.collect()}
    assert texts == {1: "é own ", 2: "ü", None: None, 4: "own"}


def test_rows_that_repeat_id_and_text_are_searched_once(spark):
    hot = messy.words(260, 5)
    rows = [(7, hot)] * 3000 + [(None, hot)] * 40 + [(1, "own " + messy.words(90, 1)), (2, messy.words(300, 2))]
    rows += [(3, "left " + hot[:900])]
    docs = messy.documents(spark, rows)
    once = S._once(S._keyed(docs, "doc_id", "text")).collect()
    assert sorted(r.n for r in once) == [1, 1, 1, 40, 3000]
    out = collections.Counter(tuple(r) for r in S.remove_repeats(docs).collect())
    lost = {(r[0], r[1], r[2]) for r in out}
    size = len(hot)
    assert (7, size, size) in lost and (None, size, size) in lost and (2, len(rows[-2][1]), 0) in lost
    assert sum(n for r, n in out.items() if r[0] == 7) == 3000 and (3, 905, 900) in lost


@pytest.mark.parametrize("length", [40, 240, 320])
def test_other_lengths(spark, length):
    rows = list(enumerate(corpus(5, 20))) + [(900, "short"), (901, None)]
    want = []
    for (d, t), flags in zip(rows, gone([(t or "").encode() for _, t in rows], length)):
        left = bytes(b for b, f in zip((t or "").encode(), flags) if not f).decode("utf-8", "ignore")
        want.append((d, left if flags.any() else t))
    out = S.without_repeats(messy.documents(spark, rows), length=length)
    assert sorted(((r[0], r[1]) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_lengths_that_symbols_do_not_fill_are_refused(spark):
    for call in (S.without_repeats, S.remove_repeats):
        with pytest.raises(ValueError):
            call(messy.documents(spark), length=250)


def in_memory(texts, shard_bytes, narrow=None):
    bodies, counts, places = [t.encode() for t in texts], collections.Counter(), []
    for d, b in enumerate(bodies):
        for found in S.anchors(b):
            for anchor, pos, low, high in zip(*(x.tolist() for x in found)):
                places.append((d, low, (anchor, pos - low, b[low:high + LENGTH])))
                counts[places[-1][2]] += 1
    keys = list(counts)
    flags = dict(zip(keys, S.repeated_windows([k[2] for k in keys], [counts[k] for k in keys], [k[0] for k in keys],
                                              shard_bytes=shard_bytes)))
    out = [np.zeros(len(b), bool) for b in bodies]
    for d, low, key in places:
        for i in np.flatnonzero(flags[key]):
            out[d][low + i:low + i + LENGTH] = True
    return out


@pytest.mark.parametrize("shard_bytes", [2_000, 50_000, 10**9])
def test_merging_any_number_of_shards(shard_bytes):
    texts = corpus(9)
    want = gone([t.encode() for t in texts])
    assert all(np.array_equal(a, b) for a, b in zip(in_memory(texts, shard_bytes), want))


def test_windows_of_long_texts_are_searched_in_blocks(monkeypatch):
    text = corpus(4)[0].encode() * 3
    whole = {(int(p + 0), int(w)) for h, p, a, b in S.anchors(text) for p, x, y in zip(p, a, b) for w in range(x, y + 1)}
    monkeypatch.setattr(S, "BLOCK", 100)
    parts = {(int(p + 0), int(w)) for h, p, a, b in S.anchors(text) for p, x, y in zip(p, a, b) for w in range(x, y + 1)}
    assert whole == parts and {w for _, w in whole} == set(range(len(text) - LENGTH + 1))
