"""Tables put aside: they go with their scratch, and no frame takes another's place."""

import gc

import pytest

from brinework.llm.shared import Kept, scratch


def exists(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_scratch_deletes_what_was_put_aside_within(spark):
    kept = Kept(spark)
    before = kept.put(spark.range(3))
    with scratch(spark):
        inner = Kept(spark)
        a = inner.put(before)
        result = kept.put(a.selectExpr("id + 1 AS id"), aside=False)
        within = inner.paths[id(a)][1]
        assert exists(spark, within)
    assert not exists(spark, within)
    assert before.count() == 3 and sorted(r.id for r in result.collect()) == [1, 2, 3]


def test_scratch_deletes_after_an_error(spark):
    inner = Kept(spark)
    with pytest.raises(RuntimeError), scratch(spark):
        a = inner.put(spark.range(3))
        raise RuntimeError
    assert not exists(spark, inner.paths[id(a)][1])


def test_dropping_a_frame_that_was_not_put_deletes_nothing(spark):
    kept = Kept(spark)
    derived = kept.put(spark.range(5)).filter("id > 1")
    gc.collect()
    for _ in range(200):
        kept.drop(spark.range(1))
    assert derived.count() == 3
