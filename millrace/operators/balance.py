"""Spreading sequences over workers by length.

The set differencing is sequential by nature, so it runs on one batch at a time: rows are grouped by a batch key and a
batch is bounded by MAX_BATCH, beyond which it is an error. Batches run side by side.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BATCH = 1_000_000


def differencing(lengths: list[int], k: int, equal_size: bool) -> list[list[int]]:
    """Largest differencing into k sets: the two states of widest spread are merged against each other until one is
    left. With equal_size each k items that follow one another by length begin as one state, so sets end equal.

    A state holds the sums and sizes of its sets and where each came from; items are put together once, at the end, so a
    merge costs k and not the items merged. Equal sums go by size, then by the sets' first state.
    """
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} items don't divide into {k} sets")
    # a set is (sum, size, number); its number leads to an item, or to the two sets it was made of, or to nothing
    made: list[tuple] = [()]

    def single(i: int) -> tuple[int, int, int]:
        made.append((i,))
        return lengths[i], 1, len(made) - 1

    def joined(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
        if not a[1] or not b[1]:
            return a if a[1] else b
        made.append((a[2], b[2]))
        return a[0] + b[0], a[1] + b[1], len(made) - 1

    empty = (0, 0, 0)
    starts = [order[j : j + k] for j in range(0, len(order), k)] if equal_size else [[i] for i in order]
    heap: list[tuple] = []
    for n, items in enumerate(starts):
        sets = sorted([*(single(i) for i in items), *[empty] * (k - len(items))], reverse=True)
        heap.append((sets[-1][0] - sets[0][0], -sets[0][0], n, sets))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        first, second = heapq.heappop(heap)[3], heapq.heappop(heap)[3]
        sets = sorted((joined(a, b) for a, b in zip(first, reversed(second))), reverse=True)
        heapq.heappush(heap, (sets[-1][0] - sets[0][0], -sets[0][0], count, sets))
        count += 1

    def items(number: int) -> list[int]:
        out, rest = [], [number]
        while rest:
            x = made[rest.pop()]
            if len(x) == 1:
                out.append(x[0])
            else:
                rest += x
        return out

    return [items(s[2]) for s in heap[0][3]] if heap else [[] for _ in range(k)]


def in_turn(lengths: list[int], k: int, equal_size: bool) -> list[list[int]]:
    """Each item, in the order given, to the set of least sum; with equal_size sets take no more than their share."""
    sums, sets = [0] * k, [[] for _ in range(k)]
    most = -(-len(lengths) // k) if equal_size else len(lengths)
    for i, n in enumerate(lengths):
        at = min((s for s in range(k) if len(sets[s]) < most), key=lambda s: (sums[s], s))
        sets[at].append(i)
        sums[at] += n
    return sets


def balanced(lengths: list[int], k: int, equal_size: bool) -> list[list[int]]:
    """k sets, each sorted, none empty, that cover all items; fewer items than sets are an error."""
    if len(lengths) < k:
        raise ValueError(f"{len(lengths)} items can't fill {k} sets")
    return [sorted(s) for s in differencing(lengths, k, equal_size)]


def partition(df: DataFrame, batch: str, position: str, size: str, k: int, equal_size: bool = False, method: str = "differencing") -> DataFrame:
    """batch, position and `part` from 0: the set of each row of its batch. Null sizes count as 0.

    Repeated positions stay apart by order of size; other columns are left out, so their names can't clash.
    """
    make = {"differencing": balanced, "in_turn": in_turn}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_BATCH:
            raise ValueError(f"a batch of {len(pdf)} rows is beyond MAX_BATCH")
        pdf = pdf.sort_values([position, "_size"], kind="stable")
        part = [0] * len(pdf)
        for p, items in enumerate(make(pdf["_size"].tolist(), k, equal_size)):
            for i in items:
                part[i] = p
        return pd.DataFrame({batch: pdf[batch], position: pdf[position], "part": part})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    chosen = df.select(batch, position, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    return chosen.groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {position} {kinds[position]}, part int")


def token_budget(df: DataFrame, batch: str, position: str, size: str, budget: int) -> DataFrame:
    """batch, position, `micro_batch`: as many micro-batches as the batch's tokens need at the budget, balanced."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_BATCH:
            raise ValueError(f"a batch of {len(pdf)} rows is beyond MAX_BATCH")
        pdf = pdf.sort_values([position, "_size"], kind="stable")
        lengths = pdf["_size"].tolist()
        part = [0] * len(pdf)
        for p, items in enumerate(balanced(lengths, max(1, min(len(lengths), -(-sum(lengths) // budget))), False)):
            for i in items:
                part[i] = p
        return pd.DataFrame({batch: pdf[batch], position: pdf[position], "micro_batch": part})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    chosen = df.select(batch, position, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    return chosen.groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {position} {kinds[position]}, micro_batch int")


def imbalance(df: DataFrame, batch: str, position: str, size: str, part: str, parts: int) -> DataFrame:
    """For each batch the least, most and mean load of consecutive parts, and the least and most of the given parts."""
    sized = df.select(batch, position, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"), F.col(part).alias("_part"))
    n = sized.groupBy(F.col(batch).alias("_b")).agg(F.count("*").alias("_n"))
    ranked = sized.withColumn("_k", F.row_number().over(Window.partitionBy(batch).orderBy(position)) - 1)  # a batch is bounded
    joined = ranked.join(n, ranked[batch].eqNullSafe(n["_b"]))
    per = F.greatest(F.ceil(F.col("_n") / parts), F.lit(1))
    plain = joined.groupBy(batch, F.floor(F.col("_k") / per).alias("_p")).agg(F.sum("_size").alias("load"))
    given = joined.groupBy(batch, "_part").agg(F.sum("_size").alias("load"))
    a = plain.groupBy(batch).agg(F.min("load").alias("min"), F.max("load").alias("max"), F.avg("load").alias("mean"))
    b = given.groupBy(F.col(batch).alias("_b")).agg(F.min("load").alias("balanced_min"), F.max("load").alias("balanced_max"))
    return a.join(b, a[batch].eqNullSafe(b["_b"])).drop("_b").withColumn("diff", F.col("max") - F.col("min"))

