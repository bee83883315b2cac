"""Benchmark decontamination against brute force."""

import random
import re

import pytest

import messy
from tillscope.llm import decontaminate as D
from tillscope.llm.common import ship_package

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), m.span()) for m in WORD.finditer(low)]


def brute(docs, items, window=10):
    wanted = {}
    for i, t in items:
        w = tuple(x for x, _ in words(t))
        size = min(window, len(w))
        for s in range(len(w) - size + 1) if size else ():
            wanted.setdefault(w[s:s + size], set()).add(i)
    sizes, out = {len(w) for w in wanted}, []
    for d, t in docs:
        own = words(t)
        plain, hit, found = [w for w, _ in own], set(), set()
        for size in sizes:
            for s in range(len(plain) - size + 1):
                if (key := tuple(plain[s:s + size])) in wanted:
                    found |= wanted[key]
                    hit |= set(range(s, s + size))
        runs = [k for k in sorted(hit) if k - 1 not in hit], [k for k in sorted(hit) if k + 1 not in hit]
        place = lambda k: len((t or "")[:k].encode())
        spans = [(place(own[a][1][0]), place(own[b][1][1])) for a, b in zip(*runs)]
        out.append((d, len(plain), len(hit), sorted(str(i) for i in found if i is not None), spans))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_words", "n_hit", "items", "spans"]
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in df.collect()), key=repr)


def bench(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "a long, b string, c string, d long").toDF(
        "item_id", "text", "TEXT", "Item_ID")


def items():
    text = messy.words(45, 2).replace(" w", ", W", 3)
    return [(0, text), (1, messy.words(10, 3)), (2, "one two three"), (2, "Z\u00fcrich"), (3, "..."), (4, None), (5, ""),
            (None, "no id at all here"), (6, messy.words(9, 5)), (7, messy.words(12, 6)), (8, messy.words(12, 6)), (-9, "one two three")]


def documents():
    given, r, rows = [t for _, t in items() if t], random.Random(13), []
    for i in range(120):
        parts = [messy.words(r.randrange(60), 100 + i)]
        for t in r.sample(given, r.randrange(4)):
            w = t.split()
            a = r.randrange(len(w))
            parts += [" ".join(w[a:] if r.random() < 0.5 else w), messy.words(r.randrange(3), i)]
        text = r.choice([" ", "\n", " - ", "\u00a0"]).join(parts)
        rows.append((i, text.upper() if r.random() < 0.2 else text))
    return rows + [(i, t) for i, t in enumerate(messy.texts())] + [(None, "one, TWO; three!"), (5, "one two three one two three")]


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 200])
def test_equals_brute_force(spark, block):
    rows = documents()
    out = D.scan(messy.documents(spark, rows), bench(spark, items()), block_bytes=block)
    assert got(out) == brute(rows, items())


@pytest.mark.parametrize("size", [64, 1000])
def test_texts_are_scanned_in_blocks(monkeypatch, size):
    table = D.Table([(str(i), D.normalised(t.encode()).decode()) for i, t in items() if t and words(t)])
    rows = documents()
    monkeypatch.setattr(D, "SCAN_BYTES", size)
    found = D.scan_texts([(t or "").encode() for _, t in rows], table)
    out = [(d, n, sum(b - a + 1 for a, b, _, _ in runs), sorted(table.names[i] for i in own if table.names[i] != "None"),
            [(c, e) for _, _, c, e in runs]) for (d, _), (n, runs, own) in zip(rows, found)]
    assert sorted(out, key=repr) == brute(rows, items())


def test_long_items_and_texts(spark):
    long_item = messy.words(50_000, 31, 100_000)
    own = long_item.split()
    rows = [(1, " ".join(own[19_990:20_015])), (2, long_item), (3, messy.words(300_000, 7, 90_000) + " " + " ".join(own[5:20])),
            (4, "x" * 3_000_000), (5, " ".join(own[:9]))]
    assert got(D.scan(messy.documents(spark, rows), bench(spark, [(1, long_item), (2, "x" * 3_000_000)]))) == brute(
        rows, [(1, long_item), (2, "x" * 3_000_000)])


def test_hashes_alone_decide_nothing(spark, monkeypatch):
    table = D.Table([("1", "a b c d e f g h i j")])
    monkeypatch.setattr(D, "_mixed", lambda h: h & D.np.uint64(0))
    weak = D.Table([("1", "a b c d e f g h i j"), ("2", "k l")])
    text = b"k m a b c d e f g h i j l k l x"
    assert D.scan_texts([text], weak) == [(16, [(2, 11, 4, 23), (13, 14, 26, 29)], {0, 1})]
    assert table.names == ["1"]


def test_spans_and_documents_are_removed(spark):
    hit = messy.words(12, 6)
    rows = [(1, f"Left {hit.upper()}, right"), (2, None), (3, "clean"), (3, hit), (None, f"\u00e9 {hit}")]
    docs, given = messy.documents(spark, rows), bench(spark, items())
    out = D.without_spans(docs, given)
    assert out.columns == messy.DOCUMENTS
    assert sorted(((r[0], r[1]) for r in out.collect()), key=repr) == sorted(
        [(1, "Left , right"), (2, None), (3, "clean"), (3, ""), (None, "\u00e9 ")], key=repr)
    left = D.without_spans(docs, given, most_hit=0)
    assert sorted(((r[0], r[1]) for r in left.collect()), key=repr) == [(2, None), (3, "clean")]
    some = D.without_spans(docs, given, most_hit=0.9, block_bytes=200)
    assert sorted(((r[0], r[1]) for r in some.collect()), key=repr) == [(1, "Left , right"), (2, None), (3, "clean")]


def test_empty_tables(spark):
    assert D.scan(messy.nothing(spark), bench(spark, items())).count() == 0
    rows = documents()[:20]
    assert got(D.scan(messy.documents(spark, rows), bench(spark, []))) == brute(rows, [])
