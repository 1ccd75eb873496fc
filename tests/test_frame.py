import pytest
from pyspark.sql import functions as F

from millrace.operators import frame


def batch(spark, labels="abcdef"):
    return frame.from_columns(spark, {"obs": list(range(1, len(labels) + 1)), "label": list(labels)}, "obs int, label string")


def labels(df):
    return [r.label for r in df.orderBy("row_idx").collect()]


def picks(spark, places):
    return spark.createDataFrame(list(enumerate(places)), "place long, at long")


def test_gather_keeps_order_and_repeats(spark):
    assert labels(frame.gather(batch(spark), picks(spark, [3, 4, 2, 0, 1, 5]))) == list("decabf")
    assert labels(frame.gather(batch(spark), picks(spark, [0, 0, 5]))) == list("aaf")
    with pytest.raises(Exception, match="no row at position 9"):
        frame.gather(batch(spark), picks(spark, [9])).collect()


def test_inverse_undoes_reorder(spark):
    p = picks(spark, [3, 4, 2, 0, 1, 5])
    assert labels(frame.reorder(frame.reorder(batch(spark), p), frame.inverse(p))) == list("abcdef")


def test_chunk(spark):
    c = frame.chunk(batch(spark), 2)
    assert [r.chunk_id for r in c.orderBy("row_idx").collect()] == [0, 0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        frame.chunk(batch(spark), 5)


def test_pop_and_rename(spark):
    popped, rest = frame.pop(batch(spark), "obs")
    assert popped.columns == ["row_idx", "obs"] and rest.columns == ["row_idx", "label"]
    with pytest.raises(KeyError):
        frame.pop(batch(spark), "none")
    with pytest.raises(ValueError):
        frame.rename(batch(spark), ["obs"], [])


def test_repeat(spark):
    b = batch(spark, "abc")
    assert labels(frame.repeat(b, 2)) == list("aabbcc")
    assert labels(frame.repeat(b, 2, interleave=False)) == list("abcabc")
    assert labels(frame.repeat(b, 0)) == []


@pytest.mark.parametrize("divisor,added,want", [(2, 1, "abca"), (3, 0, "abc"), (7, 4, "abcabca")])
def test_pad_and_unpad(spark, divisor, added, want):
    padded, n = frame.pad_to_divisor(batch(spark, "abc"), divisor)
    assert n == added and labels(padded) == list(want)
    assert labels(frame.unpad(padded)) == list("abc")


def test_fold_reorder_unfold(spark):
    f = frame.fold(frame.repeat(batch(spark, "abc"), 2), 3)
    back = frame.unfold(frame.reorder(f, picks(spark, [1, 2, 0])))
    assert labels(back) == list("bbccaa")


def test_union_columns(spark):
    b = batch(spark, "abc")
    nan = frame.from_columns(spark, {"x": [float("nan"), None, 1.0]}, "x double")
    assert frame.union_columns(nan, nan).count() == 3
    assert set(frame.union_columns(b, nan).columns) == {"row_idx", "obs", "label", "x"}
    with pytest.raises(Exception, match="differ"):
        frame.union_columns(b, b.withColumn("obs", F.col("obs") + 1)).collect()
    with pytest.raises(Exception, match="unequal sizes"):
        frame.union_columns(b, batch(spark, "ab").select("row_idx")).collect()


def test_length_and_empty(spark):
    assert frame.length(batch(spark, "abc")) == 3 and frame.length(None) == 0
    empty = batch(spark, "")
    assert frame.length(empty) == 0 and frame.pad_to_divisor(empty, 4)[1] == 0
    assert frame.positions(empty.drop("row_idx"), "obs").count() == 0
    with pytest.raises(ValueError):
        frame.from_columns(spark, {"a": [1], "b": []}, "a int, b int")


def test_positions_are_dense_and_stable(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("row"))
    out = frame.positions(df.repartition(13), "k")
    assert [(r.k, r.row_idx) for r in out.orderBy("k").collect()] == [(i, i) for i in range(1000)]


def test_cut_concat_masked(spark):
    b = batch(spark)
    assert labels(frame.cut(b, 1, 6, 2)) == list("bdf")
    assert labels(frame.cut(b, -2)) == list("ef")
    assert labels(frame.concat([b, batch(spark, "xy")])) == list("abcdefxy")
    assert labels(frame.masked(b, F.col("obs") % 2 == 0)) == list("bdf")


def test_shuffle_and_mini_batches(spark):
    b = batch(spark)
    once, again = labels(frame.shuffled(b, 5)), labels(frame.shuffled(b, 5))
    assert once == again and sorted(once) == list("abcdef")
    m = frame.mini_batches(b, 3, 2, seed=1)
    assert m.count() == 12 and m.groupBy("epoch", "batch_id").count().where("count = 3").count() == 4
    with pytest.raises(ValueError):
        frame.mini_batches(b, 4, 1)
