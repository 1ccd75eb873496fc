import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing as P


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.integers(40, 64))
def test_plan_places_every_item_once(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    placed = np.zeros_like(counts)
    for size, times, used in P.plan(counts, capacity):
        assert size <= capacity and sum(n * k for n, k in used) <= size and times > 0
        for n, k in used:
            placed[n] += times * k
    assert (placed == counts).all()


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7), st.integers(1, 30))
def test_fill_is_the_fullest(lengths, size):
    best = max(s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= size)
    total, used = P.fill(np.bincount(lengths, minlength=size + 13), size)
    assert total == best == sum(n * k for n, k in used)
    assert all(k <= lengths.count(n) for n, k in used)


def test_waste_is_small():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(20, 240, 5000), minlength=513)
    bins = P.plan(counts, 512)
    room = sum(s * t for s, t, _ in bins)
    assert room < 1.01 * (counts * np.arange(513)).sum()


def test_frame(spark):
    rows = [(i, ["a", "A", None, "zzz"][i % 4], [10, 33, 70, 0, None][i % 5], "x") for i in range(400)]
    items = spark.createDataFrame(rows, "row_idx long, data_source string, size int, capacity string")
    caps = spark.createDataFrame([("a", 32), ("b", 64), (None, 5), ("c", None)], "data_source string, capacity int")
    out = P.pack(items, "row_idx", "data_source", "size", caps).toPandas()
    want = {i: s for i, _, s, _ in rows if s}
    assert out.groupby("row_idx").length.sum().to_dict() == want
    bins = out.groupby("container_id").agg(total=("length", "sum"), room=("capacity", "max"), groups=("data_source", "nunique"))
    assert (bins.total <= bins.room).all() and (bins.groups == 1).all()
    whole = out.merge(items.toPandas()[["row_idx", "size"]], on="row_idx")
    limit = np.where(whole.data_source == "a", 32, 64)
    assert (whole[whole["size"] <= limit].groupby("row_idx").size() == 1).all()  # only longer ones are cut
    again = P.pack(items.repartition(7), "row_idx", "data_source", "size", caps).toPandas()
    key = ["row_idx", "part"]
    assert out.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert P.pack(items.limit(0), "row_idx", "data_source", "size", caps).count() == 0
    assert P.pack(items, "row_idx", "data_source", "size", caps.limit(0)).count() > 0


def test_lengths_once(spark):
    df = spark.createDataFrame([(1, "a", [1, 0, 1]), (1, "a", [1, 0, 1]), (2, None, None), (3, "b", [])], "row_idx long, data_source string, attention_mask array<int>")
    assert {(r.row_idx, r.size) for r in P.sequence_lengths(df).collect()} == {(1, 2), (2, 0), (3, 0)}


def test_a_hot_length_is_numbered_in_parts(spark, monkeypatch):
    items = spark.createDataFrame([(i, "a", 10 if i % 3 else 7) for i in range(900)], "row_idx long, data_source string, size int")
    caps = spark.createDataFrame([("a", 32)], "data_source string, capacity int")
    monkeypatch.setattr(P, "PART_ROWS", 50)
    out = P.pack(items, "row_idx", "data_source", "size", caps).toPandas()
    bins = out.groupby("container_id").agg(total=("length", "sum"), room=("capacity", "max"))
    assert len(out) == 900 and (bins.total <= bins.room).all() and bins.total.sum() > 0.9 * bins.room.sum()
    alone = P.pack(items, "row_idx", "data_source", "size", caps.limit(0)).toPandas()
    assert (alone.capacity == alone.length).all() and alone.container_id.nunique() == 900
