"""The classifier when Spark cuts the files into other tasks from one job to the next."""

import pytest

import messy
from tillscope.llm import kneser_ney as K
from tillscope.llm.common import ship_package


def test_scans_cut_differently_give_the_same_result(spark, scratch, monkeypatch):
    rows = [(i, messy.words(30, i), "en") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{scratch}/docs")
    docs, trusted = spark.read.parquet(f"{scratch}/docs"), spark.range(200).toDF("doc_id")
    ship_package(spark)
    monkeypatch.setattr(K, "SPLIT_ROWS", 150, raising=False)
    want = sorted(map(tuple, K.classify(docs, trusted, plain_scan=True).collect()))
    assert len(want) == 400
    runs = K.runs_by_split
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def later(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # the row group's task starts elsewhere now
        return runs(*args)

    monkeypatch.setattr(K, "runs_by_split", later)
    try:
        got = sorted(map(tuple, K.classify(docs, trusted, plain_scan=True).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r[0], r[-1]) for r in got] == [(r[0], r[-1]) for r in want]
    assert all(abs(g[3] - w[3]) < 1e-9 * w[3] for g, w in zip(got, want))


def test_a_missing_file_raises(scratch):
    with pytest.raises(FileNotFoundError):
        K._from_file(scratch, 1, ["doc_id"])


def test_characters_share_no_symbols():
    every = [c for c in map(chr, [*range(0x100), *range(0x370, 0x3000, 7), *range(0x4E00, 0xA000), *range(0x1F300, 0x1F700)])
             if ord(c) > 32 and ord(c) not in (0x85, 0xA0)]
    seen = {tuple(K.symbols(c).tolist()) for c in every}
    assert len(seen) == len(every)
    assert all(len(s) == 1 and s[0] < K.DIRECT or len(s) == 2 and K.DIRECT <= s[0] < K.TRAIL <= s[1] < K.SYMBOLS for s in seen)
    assert K.symbols("a\n\u00a0b").tolist() == [97, 32, 32, 98]
    text = "aé日本語 \U0001f600z" * 9
    assert K.symbols(text).tolist() == [x for c in text for x in K.symbols(c).tolist()]


def test_blocks_change_no_run(monkeypatch):
    for text in ("", "a", "日本語テキスト", "ab日c" * 30):
        monkeypatch.setattr(K, "BLOCK", 1 << 20)
        want = [int(x) for r in K.text_runs(text) for x in r]
        assert len(want) == len(K.symbols(text)) + 1
        for block in (1, 3, 8):
            monkeypatch.setattr(K, "BLOCK", block)
            assert [int(x) for r in K.text_runs(text) for x in r] == want


def test_splits_are_bounded_by_characters(spark, scratch, monkeypatch):
    monkeypatch.setattr(K, "SPLIT_ROWS", 64)
    monkeypatch.setattr(K, "ROW_CHARS", 16)
    rows = [(i, "x" * (8 if i % 5 else 16 << (i // 5 % 9))) for i in range(600)] + [(601, None), (602, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{scratch}/t")
    keyed = spark.read.parquet(f"{scratch}/t").withColumn("class", K.length_class()).withColumn("split", K.split_key())
    sizes = {}
    for r in keyed.collect():
        n, chars = sizes.get(r.split, (0, 0))
        sizes[r.split] = n + 1, chars + len(r.text or "")
    assert max(chars for n, chars in sizes.values() if n > 1) <= 2 * 64 * 16
    assert {r["class"] for r in keyed.select("class").distinct().collect()} == set(range(7))


def test_long_texts_in_splits_of_their_own_change_nothing(spark, scratch, monkeypatch):
    rows = [(i, messy.words(30 if i % 4 else 900, i), "en") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2).write.parquet(f"{scratch}/docs")
    docs, trusted = spark.read.parquet(f"{scratch}/docs"), spark.range(100).toDF("doc_id")
    ship_package(spark)
    want = {r[0]: r[1:] for r in K.classify(docs, trusted, plain_scan=True).collect()}
    monkeypatch.setattr(K, "ROW_CHARS", 128)
    got = {r[0]: r[1:] for r in K.classify(docs, trusted, plain_scan=True).collect()}
    assert got.keys() == want.keys() and len(got) == 200
    assert all(got[i][1] == w[1] and abs(got[i][2] - w[2]) < 1e-9 * w[2] and got[i][-1] == w[-1] for i, w in want.items())
