"""The pipeline on tables whose rows repeat whole or have no id."""

import corpus_pipeline
import messy

DIR = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)
LONG = [messy.words(150, s) for s in range(70, 73)]


def plain(df):
    return sorted(((r[0], r[1]) for r in df.collect()), key=repr)


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = [(1, LONG[0]), (1, LONG[0]), (None, LONG[1]), (None, LONG[1]), (None, LONG[2]), (4, LONG[2]), (3, LONG[2]),
            (None, None), (None, ""), (8, "short"), (8, "short"), (8, "other")]
    docs = messy.documents(spark, rows)
    kept = STAGE["exact_dedup"](spark, docs, DIR)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    got = plain(kept)
    assert [r for r in got if r[1]] == sorted([(1, LONG[0]), (None, LONG[1]), (4, LONG[2]), (8, "short"), (8, "other")], key=repr)
    assert len([r for r in got if not r[1]]) == 1
    cut = STAGE["suffix_dedup"](spark, kept, DIR)  # nothing is left that repeats, so no text is lost
    assert plain(cut) == got


def test_simhash_keeps_one_row_of_each_component(spark):
    near = LONG[0].split()
    near = [" ".join(near), " ".join(near) + "  ", "\t" + " ".join(near)]  # equal words, so equal fingerprints
    rows = [(5, near[0]), (5, near[1]), (None, near[2]), (7, near[0]),  # a shared id and a null beside it
            (None, LONG[1]), (None, LONG[1] + " "), (5, LONG[2]), (2, LONG[2] + " ")]
    docs = messy.documents(spark, rows)
    kept = STAGE["simhash_near_dedup"](spark, docs, DIR)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    got = [(d, t.strip()) for d, t in plain(kept)]
    assert sorted(got, key=repr) == sorted([(5, LONG[0]), (None, LONG[1]), (2, LONG[2])], key=repr)
