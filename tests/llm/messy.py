"""Small tables with what real ones hold: nulls, empty and long texts, repeats, clashing names."""

import random

from tillscope.llm.common import ship_package

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars", "TEXT", "Doc_ID", "k"]


def words(n: int, seed: int, stock: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(stock):03d}{'aeiou'[r.randrange(5)]}" for _ in range(n))


def texts() -> list[str | None]:
    long = words(12_000, 1)
    passage = words(120, 2)
    base = [words(60, s) for s in range(10, 16)]
    return [
        None, "", " \t\n", "one", "One", "one two", "ünï cödé 日本語 \U0001f600 x", "12 34 !!", "a b c d e",
        long, long, long + " tail", *base, base[0], base[0], base[1] + " more", base[2].replace("w", "W", 1),
        "left one " + passage + " right", passage, words(30, 3) + " " + passage + " " + words(30, 4),
        "ab " * 900, "é" * 700, "x" * 400, "y" * 399, "y" * 399, "<|endoftext|> it's \x1c odd space", "nul\0byte",
    ]


def documents(spark, rows=None):
    """Documents with clashing extra columns; ids may repeat or be null."""
    ship_package(spark)
    if rows is None:
        rows = [(i, t) for i, t in enumerate(texts())] + [(5, "other text of five"), (None, "no id here"), (None, "one"),
                                                          (3, "one"), (-7, words(60, 10))]
    data = [(d, t, "en" if (d or 0) % 2 else None, None, 1 if t is None else len(t), "clash", 99, b"k") for d, t in rows]
    return spark.createDataFrame(
        data, "c0 long, c1 string, c2 string, c3 string, c4 long, c5 string, c6 long, c7 binary").toDF(*DOCUMENTS)


def nothing(spark):
    return documents(spark, []).limit(0)


def rows(spark):
    """``(doc_id, text or empty)`` of ``documents``."""
    return [(r[0], r[1] or "") for r in documents(spark).collect()]
