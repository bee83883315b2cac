"""Exact dedup against brute force, with forced hash collisions."""

import hashlib

import pytest
from pyspark.sql import functions as F

import messy
from tillscope.llm import queries
from tillscope.llm.exact_dedup import exact_dedup


def brute(rows, best):
    out = []
    for d, t in rows:
        ids = [x for x, u in rows if u == t and x is not None]
        keep = best(ids) if ids else None
        out.append((d, keep, sum(u == t for _, u in rows), keep is None or d == keep,
                    hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_equals_brute_force(spark, keep, best):
    df = exact_dedup(messy.documents(spark), keep=keep)
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got(df) == brute(messy.rows(spark), best)


def test_texts_under_one_hash_are_told_apart(spark):
    weak = exact_dedup(messy.documents(spark), keep="largest", hash_fn=lambda c: F.length(c) % 3)
    assert got(weak) == brute(messy.rows(spark), max)


def test_empty_table(spark):
    assert exact_dedup(messy.nothing(spark)).count() == 0


def test_a_third_of_the_rows_are_copies(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i % 50}") for i in range(900)]
    assert got(exact_dedup(messy.documents(spark, rows), keep="largest")) == brute(rows, max)


def test_query_has_no_python(spark):
    plan = queries.op10_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
