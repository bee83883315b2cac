"""Filter interactions against brute force over all orders."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

import messy
from tillscope.llm import filter_audit as A
from tillscope.llm.common import ship_package

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def labels(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "a long, b int, c int, d int, e string").toDF(
        "doc_id", "quality", "toxic", "QUALITY", "part")


def brute(docs, marks):
    rows, first = [], {}
    for d, t, p in docs:
        t = t or ""
        if d is not None:
            first[t] = min(d, first.get(t, d))
    for d, t, p in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search("[#$%&*|]", t)), d is not None and first[t] < d)) if x}
        own = [m for m in marks if d is not None and m[0] == d]
        rows.append((p or "", fails, any(m[1] == 1 for m in own), any(m[2] == 1 for m in own)))
    out, orders = [], ["".join(p) for p in permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        own, shap, lines = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in orders:
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shap[f] += len(gone)
                lines.append([part, order, step, len(left), len(gone), sum(f in r[1] for r in own) - len(gone),
                              sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        out += [(*line[:-1], shap[line[-1]]) for line in lines]
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def corpus():
    many, few, loud = messy.words(220, 1, 4000), "ab cd " * 150, ("Up lo " * 110) + messy.words(120, 9, 4000)
    texts = [many, few, loud, many + " $", few + "#", "short", "SHORT %", "", None, loud + " | x", many + "\u00a0\x1c", many]
    rows = [(i, texts[i % len(texts)], ("en", "de", None, "")[i % 4]) for i in range(60)]
    return rows + [(None, many, "en"), (None, many, "en"), (3, "other text of three", "en"), (3, many, "de"), (3, many, "fr"),
                   (-5, "SHORT %", "en"), (-5, "SHORT %", "en")]


def docs(spark, rows):
    plain = messy.documents(spark, [r[:2] for r in rows]).toDF(*(f"c{i}" for i in range(8)))
    ship_package(spark)
    return spark.createDataFrame([(d, t, p, None, 0, "clash", 99, b"k") for d, t, p in rows], plain.schema).toDF(*messy.DOCUMENTS)


MARKS = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (2, 0, None), (3, None, 1), (5, 1, 0), (None, 1, 1), (12, 1, 1), (777, 1, 1)]


@pytest.mark.parametrize("salt_rows", [2_000, 1])
def test_equals_brute_force(spark, salt_rows):
    rows = corpus()
    out = A.audit(docs(spark, rows), labels(spark, MARKS), salt_rows=salt_rows)
    assert got(out) == brute(rows, MARKS)


def test_texts_under_one_hash_are_told_apart(spark):
    rows = corpus()
    out = A.audit(docs(spark, rows), labels(spark, MARKS), hash_fn=lambda c: F.length(c) % 2)
    assert got(out) == brute(rows, MARKS)


def test_a_third_of_the_rows_share_a_text_and_an_id(spark):
    rows = [(i, "hot text" if i % 3 == 0 else messy.words(3, i), "en") for i in range(900)] + [(7, "x", "de")] * 300
    out = A.audit(docs(spark, rows), labels(spark, MARKS), salt_rows=50)
    assert got(out) == brute(rows, MARKS)


def test_a_very_long_text(spark):
    rows = [(1, messy.words(300_000, 3, 100_000), "en"), (2, "A" * 2_000_000, "en"), (3, "A" * 2_000_000, "en")]
    assert got(A.audit(docs(spark, rows), labels(spark, MARKS))) == brute(rows, MARKS)


def test_empty_tables(spark):
    assert A.audit(messy.nothing(spark), labels(spark, MARKS)).count() == 0
    rows = corpus()
    assert got(A.audit(docs(spark, rows), labels(spark, []))) == brute(rows, [])
