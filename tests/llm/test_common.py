"""Column picking, semi-joins and what workers keep."""

import pytest

import messy
from tillscope.llm import common, worker


def test_pick_takes_exact_names(spark):
    df = messy.documents(spark)
    assert sorted(r.x or "" for r in common.pick(df, x="text").collect()) == sorted(t for _, t in messy.rows(spark))
    assert {r.y for r in common.pick(df, y="Doc_ID").collect()} == {99}
    with pytest.raises(ValueError):
        common.pick(df, z="missing")


def test_semi_join_matches_nulls_and_keeps_clashing_columns(spark):
    df = messy.documents(spark)
    keep = spark.createDataFrame([(1,), (None,)], "doc_id long")
    out = common.semi_join(df, keep, doc_id=("doc_id", lambda c: c))
    assert out.columns == messy.DOCUMENTS
    assert sorted((r[0] for r in out.collect()), key=repr) == [1, None, None]


def test_a_worker_keeps_one_operators_state():
    worker.kept("a")["x"] = 1
    assert worker.kept("a") == {"x": 1}
    assert worker.kept("b") == {} and worker.kept("a") == {}


def test_stored_and_cut_keep_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "a long, b string")
    for out in (common.stored(df, "test"), common.cut(df)):
        assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, None), (None, "x")], key=repr)
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
