import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import ragged
from millrace.functions import sequences as Q
from millrace.operators import advantage as A
from millrace.operators import training as R


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[0] for v in values.values())], schema).select(column.alias("x")).first().x


def test_general_advantage_golden(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0], [0.1, 0.2, 0.3]), (None, [1.0]), ([], [])], "r array<double>, v array<double>")
    got = [r.x for r in df.select(A.general_advantage("r", "v", 0.9, 0.8).alias("x")).collect()]
    assert [round(x, 5) for x in got[0]] == [0.49328, 0.574, 0.7] and got[1] is None and got[2] == []


def test_discounted_stops_at_mask(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0], [1, 0, 1]), ([1.0], [1])], "r array<double>, m array<int>")
    got = [r.x for r in df.select(A.discounted_returns("r", "m", 0.5).alias("x")).collect()]
    assert got == [[1.0, 1.5, 1.0], [1.0]]  # what the masked step would hand back is cut
    back = [r.x for r in df.select(A.remax_returns("r", "m").alias("x")).collect()]
    assert back == [[2.0, 1.0, 1.0], [1.0]]


@pytest.mark.parametrize("ends,want", [(1, [[1, 1, 1, 0], [1, 1, 1, 1]]), ([1, 5], [[1, 1, 0, 0], [1, 1, 1, 1]])])
def test_end_mask(spark, ends, want):
    df = spark.createDataFrame([([7, 5, 1, 1],), ([7, 8, 9, 9],)], "i array<long>")
    assert [r.x for r in df.select(Q.end_mask("i", ends).alias("x")).collect()] == want


def test_padding(spark):
    assert one(spark, Q.pad("i", 4, 0, left=True), i=([1, 2], "array<long>")) == [0, 0, 1, 2]
    assert one(spark, Q.truncate("i", 2, "left"), i=([1, 2, 3], "array<long>")) == [2, 3]
    assert one(spark, Q.truncate("i", 5, "left"), i=([1, 2, 3], "array<long>")) == [1, 2, 3]
    with pytest.raises(Exception, match="longer"):
        one(spark, Q.truncate("i", 2, "error"), i=([1, 2, 3], "array<long>"))
    assert one(spark, Q.strip_left("i", 0), i=([0, 0, 4, 0], "array<long>")) == [4, 0]
    assert one(spark, Q.strip_left("i", 0), i=([0, 0], "array<long>")) == []
    assert one(spark, Q.unpad("i", "m"), i=([1, 2, 3], "array<long>"), m=([0, 1, 1], "array<int>")) == [2, 3]


def test_masked_statistics(spark):
    v, m = ([1.0, 2.0, None, 100.0], "array<double>"), ([1, 1, 1, 0], "array<int>")
    assert one(spark, Q.masked_sum("v", "m"), v=v, m=m) == 3.0
    assert abs(one(spark, Q.masked_mean("v", "m"), v=v, m=m) - 1.0) < 1e-6
    assert abs(one(spark, Q.masked_var("v", "m"), v=v, m=m) - 1.0) < 1e-6
    assert one(spark, Q.masked_var("v", "m"), v=v, m=([1, 0, 0, 0], "array<int>")) is None


def test_placing(spark):
    assert one(spark, Q.place_at(F.lit(2.0), F.lit(-1), 3), i=(1, "int")) == [0.0, 0.0, 2.0]
    assert one(spark, Q.place_at(F.lit(2.0), F.lit(0), 3), i=(1, "int")) == [2.0, 0.0, 0.0]


def test_masks_of_supervised_rows(spark):
    assert one(spark, Q.sft_mask("a", F.lit(3), F.lit(2)), a=([1] * 6, "array<int>")) == [0, 0, 1, 1, 0, 1]
    assert one(spark, Q.turn_mask("n", "w", 6), n=([2, 1, 2], "array<int>"), w=([False, True, True], "array<boolean>")) == [0, 0, 1, 1, 1, 0]


def test_dense_rewards(spark):
    assert one(spark, Q.common_prefix(F.lit("12,x"), F.lit("12,13")), i=(1, "int")) == 3
    assert one(spark, Q.common_prefix(F.lit(""), F.lit("12")), i=(1, "int")) == 0
    assert one(spark, Q.arithmetic_sequence(F.lit(7), F.lit(8), 3, 20), i=(1, "int")) == [9, 10, 11]
    assert one(spark, Q.arithmetic_sequence(F.lit(9), F.lit(10), 3, 12), i=(1, "int")) == [11, 0, 1]


def test_softmax(spark):
    e = one(spark, Q.entropy("l"), l=([1000.0, 1000.0], "array<double>"))
    assert abs(e - math.log(2)) < 1e-9
    assert abs(one(spark, Q.log_softmax_at("l", F.lit(1)), l=([0.0, 0.0, 0.0], "array<double>")) + math.log(3)) < 1e-9


def test_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 2.0), (None, None)], "g string, s double").selectExpr("*", "'x' as advantage_note")
    got = {(r.g, r.s): r.advantage for r in A.grpo(df, "g", "s").collect()}
    assert abs(got["a", 3.0] - 1 / (2**0.5 + 1e-6)) < 1e-9 and abs(got["b", 5.0] - 5 / (1 + 1e-6)) < 1e-9
    assert got[None, None] is None and abs(got[None, 2.0] - 2 / (1 + 1e-6)) < 1e-9
    assert {(r.g, r.s): r.advantage for r in A.rloo(df, "g", "s").collect()}["a", 3.0] == 2.0
    assert A.varied_groups(df, "g", "s").where("g = 'b'").count() == 1
    with pytest.raises(ValueError):
        A.outcome_advantage(df, "none", "g", "s")
    assert A.grpo(df.limit(0), "g", "s").count() == 0


def test_whitening(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(10)] + [(None, 1.0)], "v double, w double")
    rows = A.whitened(df, "v", "w").agg(F.avg("whitened"), F.var_samp("whitened"), F.count("whitened")).first()
    assert abs(rows[0]) < 1e-6 and abs(rows[1] - 1) < 1e-6 and rows[2] == 10


def test_ragged_rows_and_nulls(spark):
    df = spark.createDataFrame([([1.0, None, 2.0],), (None,), ([],), ([5.0],)], "v array<double>").repartition(1)
    got = [r.x for r in df.select(ragged.fold(ragged.reverse_cumsum, "v").alias("x")).collect()]
    assert got == [[3.0, 2.0, 2.0], None, [], [5.0]]


def test_assembled_rows(spark):
    df = spark.createDataFrame([([0, 4, 5], [0, 1, 1], [6, 1, 0])], "p array<long>, m array<int>, r array<long>")
    row = R.rollout_rows(df, "p", "r", "m", 1).first()
    assert row.input_ids == [0, 4, 5, 6, 1, 0] and row.attention_mask == [0, 1, 1, 1, 1, 0] and row.position_ids == [0, 0, 1, 2, 3, 4]


def test_controller():
    c = R.AdaptiveController(0.1, 6.0, 1000)
    assert abs(c.update(60.0, 100) - 0.1 * 1.02) < 1e-12 and R.FixedController(0.2).update(9, 9) == 0.2


def test_preference_pair_masks(spark):
    pair = one(spark, R.preference_pair(F.col("p"), F.col("a"), F.col("b"), 4, 0), p=([1], "array<long>"), a=([2, 3], "array<long>"), b=([4], "array<long>"))
    assert pair[0].input_ids == [1, 2, 3, 0] and pair[0].attention_mask == [1, 1, 1, 0] and pair[1].attention_mask == [1, 1, 0, 0]


def test_packed_bounds_of_all_sequences(spark):
    rows = [(g, i, (i * 7) % 5 if i % 6 else None) for g, n in (("val-001", 40), ("train", 25), (None, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "uid string, row_idx long, len int").repartition(3)
    got = {(r.uid, r.row_idx): (r.begins, r.ends) for r in R.packed(df, "uid", "row_idx", "len", block=8).collect()}
    want, at = {}, {}
    for g, i, n in rows:
        want[g, i] = (at.get(g, 0), at.get(g, 0) + (n or 0))
        at[g] = want[g, i][1]
    assert got == want


def test_opposed_pairs_of_all_rows(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([0.0, 0.5, 1.0, -2.0]), rng.choice([0, 1, 5, 6, 40, None])) for g, n in (("hot", 90), ("b", 9), ("two", 2), ("one", 1), (None, 12)) for _ in range(n)]
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        sign = lambda x: (x > 0) - (x < 0)
        hits = [None not in (a[2], b[2]) and sign(a[1] - b[1]) == sign(b[2] - a[2]) for i, a in enumerate(own) for b in own[i + 1 :]]
        if hits:
            want[g] = (len(hits), sum(hits))
    df = spark.createDataFrame(rows, "g string, s double, n int")
    assert {r.g: (r.pairs, r.opposed) for r in A.opposed_pairs(df, "g", "s", "n").collect()} == want
    assert A.opposed_pairs(df.limit(0), "g", "s", "n").count() == 0
