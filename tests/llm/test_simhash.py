"""SimHash fingerprints, vantage-point shards and components against brute force."""

import random
import re

import numpy as np
import xxhash

import messy
from tillscope.llm import queries
from tillscope.llm import simhash as S
from tillscope.llm.components import components


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, reach=2):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    assert got(S.near_duplicates(messy.documents(spark))) == brute(messy.rows(spark))


def test_many_shards_and_groups(spark):
    r = random.Random(5)
    base = [messy.words(90, s) for s in range(60)]
    rows = []
    for i in range(500):
        w = r.choice(base).split() if i % 3 else base[0].split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    df = S.near_duplicates(messy.documents(spark, rows), reach=3, shard_size=40)
    assert got(df) == brute(rows, 3)


def test_empty_table(spark):
    assert S.near_duplicates(messy.nothing(spark)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(queries.op2_simhash(spark, d)) == brute(rows)


def links_brute(fps, reach):
    f = S.Forest(len(fps))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= reach)
    f.link(a, b)
    return f.roots(np.arange(len(fps)))


def test_shards_lose_no_link():
    rng = np.random.default_rng(2)
    fps = list(rng.integers(0, 2**64, 800, dtype=np.uint64))
    for _ in range(2500):
        x = fps[rng.integers(len(fps))]
        for _ in range(rng.integers(1, 4)):
            x = x ^ (np.uint64(1) << np.uint64(rng.integers(64)))
        fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    want = links_brute(fps, 2)
    for shards in (1, 4, 32):
        tree, forest = S.build_tree(fps[::3], shards, 2), S.Forest(len(fps))
        for _, own, home in S.route(tree, fps, np.ones(len(fps), bool), 2):
            a, b = S.shard_links(own, home, 2)
            forest.link(np.searchsorted(fps, a), np.searchsorted(fps, b))
        assert np.array_equal(forest.roots(np.arange(len(fps))), want)


def test_a_crowd_that_no_vantage_splits(monkeypatch):
    monkeypatch.setattr(S, "LEAF", 16)
    monkeypatch.setattr(S, "choose", lambda *a: None)
    masks = S._masks(2)
    fps = np.unique(masks[::4] ^ np.uint64(0x1234567890ABCDEF))
    a, b = S.shard_links(fps, np.ones(len(fps), bool), 2)
    forest = S.Forest(len(fps))
    forest.link(np.searchsorted(fps, a), np.searchsorted(fps, b))
    assert np.array_equal(forest.roots(np.arange(len(fps))), links_brute(fps, 2))
    assert len(a) < len(fps)  # a forest, not all pairs


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(120)] + [(7, 7), (-5, 2000)]
    group = {}
    find = lambda x: x if group.setdefault(x, x) == x else find(group[x])
    import sys
    sys.setrecursionlimit(10_000)
    for a, b in edges:
        x, y = find(a), find(b)
        group[max(x, y)] = min(x, y)
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    got_ = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got_ == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
