import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import balance


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 500), min_size=4, max_size=60), st.integers(1, 4))
def test_covers_all_items_once(lengths, k):
    sets = balance.balanced(lengths, k, False)
    assert sorted(i for s in sets for i in s) == list(range(len(lengths))) and all(s == sorted(s) for s in sets)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=12), st.integers(1, 4))
def test_equal_sizes(lengths, k):
    lengths = lengths * k
    assert {len(s) for s in balance.balanced(lengths, k, True)} == {len(lengths) // k}


def test_close_to_the_best():
    sets = balance.balanced([8, 7, 6, 5, 4], 2, False)
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in sets)
    assert sums[1] - sums[0] <= 2


def test_errors_and_ties():
    with pytest.raises(ValueError):
        balance.balanced([1], 2, False)
    with pytest.raises(ValueError):
        balance.balanced([1, 2, 3], 2, True)
    assert balance.balanced([5, 5, 5, 5], 2, True) == balance.balanced([5, 5, 5, 5], 2, True)


def test_in_turn_takes_input_order():
    assert balance.in_turn([5, 1, 1, 4], 2, False) == [[0], [1, 2, 3]]


def test_frames(spark):
    rows = [(b, i, 10 * (i + 1) if i else None) for b in ("x", None) for i in range(8)]
    df = spark.createDataFrame(rows, "batch string, pos long, size int").withColumnRenamed("size", "len").selectExpr("*", "1 as part")
    out = balance.partition(df, "batch", "pos", "len", 2, equal_size=True)
    assert out.count() == 16 and out.groupBy("batch", "part").count().where("count = 4").count() == 4
    micro = balance.token_budget(df, "batch", "pos", "len", 100)
    loads = micro.join(df.drop("part"), ["pos"]).count()
    assert loads == 32 and micro.agg({"micro_batch": "max"}).first()[0] == 3
    report = balance.imbalance(df.where("batch = 'x'").drop("part").join(out, ["batch", "pos"]), "batch", "pos", "len", "part", 2).first()
    assert report["min"] == 90 and report["max"] == 260 and report["balanced_max"] - report["balanced_min"] <= 40
    assert balance.partition(df.limit(0), "batch", "pos", "len", 2).count() == 0
