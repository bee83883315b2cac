"""Hash-prefix forest: recall against brute force, exact scores, odd vectors."""

import numpy as np
import pytest

from tillscope.llm import ann, queries
from tillscope.llm.common import ship_package

NAMES = ["vec_id", "embedding", "label", "VEC_ID", "v"]


def table(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows],
                                 "a long, b array<float>, c int, d long, e string").toDF(*NAMES)


def brute(rows, asked, k=5):
    ok = {i: np.array(v, np.float64) for i, v in rows
          if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in asked:
        score = sorted(((-float(ok[q] @ v / np.linalg.norm(ok[q]) / np.linalg.norm(v)), i)
                        for i, v in ok.items() if i != q and len(v) == len(ok[q])))
        out[q] = [(i, -s) for s, i in score[:k]]
    return out


def found(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.97), ("sf0.1", 0.9)])
def test_recall_of_the_query(spark, sf, least):
    d = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = found(queries.op4_hash_forest(spark, d))
    asked = [i for i, _ in rows if i % 50 == 0]
    want = brute(rows, asked)
    assert set(got) == set(asked) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in asked)
    assert hits >= least * 5 * len(asked)
    exact = {q: dict(v) for q, v in brute(rows, asked, k=len(rows)).items()}
    for q in asked:
        assert all(abs(exact[q][i] - s) < 1e-12 for i, s in got[q])


def test_recall_at_a_larger_size_over_shards(spark, monkeypatch):
    """Random directions, the hardest case, dealt over several shards."""
    ship_package(spark)
    drawn = np.random.default_rng(20).standard_normal((9_000, 64)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(drawn)]
    vectors = table(spark, rows)
    monkeypatch.setattr(ann, "SHARD_ROWS", 3_000)
    got = found(ann.nearest(vectors, vectors.toDF(*"abcde").where("a % 300 = 0").toDF(*NAMES)))
    want = brute(rows, [i for i, _ in rows if i % 300 == 0])
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in want.items()) >= 0.9 * 5 * len(want)


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, []), (6, [0.0, 0.0]),
            (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 0.1]), (10, [-1.0, 0.0]),
            (3, [0.5, 0.5]), (11, [1e-30, 0.0]), (12, [1.0, 2.0, 3.0]), (13, [3e38, 0.0])]
    df = table(spark, rows)
    got = found(ann.nearest(df, df.where("embedding is null or label = 0"), k=3))
    assert set(got) == {0, 1, 2, 3, 10, 11, 13}
    assert [i for i, _ in got[0]] == [1, 2, 11] and [i for i, _ in got[2]] == [0, 1, 11]
    assert 3 not in {i for i, _ in got[3]}
    assert all(abs(s - 1) < 1e-12 for _, s in got[0])


def test_few_rows_and_empty_tables(spark):
    two = table(spark, [(0, [1.0, 0.0]), (50, [0.0, 1.0])])
    assert found(ann.nearest(two, two)) == {0: [(50, 0.0)], 50: [(0, 0.0)]}
    none = two.limit(0)
    assert ann.nearest(none, none).count() == 0 and ann.nearest(two, none).count() == 0


def test_candidates_come_from_the_longest_prefixes():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((500, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    forest = ann.Forest(unit, trees=4, bits=16)
    masks = list(forest.candidates(unit[:20], 30))
    assert all(m[i] and 8 <= m.sum() < 500 for i, m in enumerate(masks))
    everything = list(forest.candidates(unit[:3], 10_000))
    assert all(m.all() for m in everything)
