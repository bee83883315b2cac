"""Hash-prefix forest on tables with a hot vector or a hot id."""

import numpy as np

from test_ann import brute, found, table
from tillscope.llm import ann


def test_a_hot_vector_leaves_the_others_found(spark):
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(64)
    hot /= np.linalg.norm(hot)
    unit = rng.standard_normal((8000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    aside = rng.standard_normal((40, 64))
    aside -= np.outer(aside @ hot, hot)
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    asked = 0.35 * hot + np.sqrt(1 - 0.35 ** 2) * aside
    data = np.concatenate([asked, unit, np.repeat(hot[None], 4000, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    df = table(spark, rows)
    got = found(ann.nearest(df, table(spark, rows[:40])))
    want = brute(rows[:8040] + rows[8040:8046], range(40))  # more copies than six never are among the five
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert all(len(got[q]) == 5 for q in want) and sum(hits) >= 0.93 * 5 * 40


def test_a_hot_id_does_not_crowd_out_others(spark):
    rng = np.random.default_rng(4)
    near = [[1.0, float(x)] for x in rng.uniform(0, 0.01, 60)]
    rows = [(0, [1.0, 0.0])] + [(1, v) for v in near] + [(i, [1.0, 0.1 * i]) for i in range(2, 12)] + [(2, [1.0, 0.2])] * 30
    df = table(spark, rows)
    got = found(ann.nearest(df, table(spark, rows[:1])))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]


def test_smallest_ids_of_a_shared_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30, 0, -1)] + [(99, [2.0, 1.0])]
    df = table(spark, rows)
    got = found(ann.nearest(df, table(spark, [rows[0], rows[29]])))
    assert [i for i, _ in got[1]] == [2, 3, 4, 5, 6] and [i for i, _ in got[30]] == [1, 2, 3, 4, 5]
