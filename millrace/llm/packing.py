"""Problem 3: filling containers of fixed capacity with sequences, with as little unused space as possible.

Method: variable-capacity best-fit. Sequences of one source and length are interchangeable, so the plan is made on
counts by length, whose size is bounded by sources times capacities and not by rows. For each source all permitted
lengths are filled side by side by an exact subset-sum over the lengths still at hand; the bin of least cost, opening
included, is taken as often as the counts allow; at last every bin is downsized to the least permitted length that holds
its contents. Sequences then find their bin by their rank among the sequences of their source and length, which is
counted in as many parts as a length needs, so no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Permitted lengths of a container as shares of the source's capacity.
SHARES = (0.25, 0.5, 0.75, 1.0)
#: What opening a container costs beside its length, as a share of the capacity: many small bins cost more than one.
OPENING = 0.25
#: Sequences of one source and length whose ranks are counted in one part; a hotter length has as many parts as it needs.
PART_ROWS = 250_000
#: The plan is made on the driver, on one count for each source and length: at most the sum of the capacities, which is
#: known before anything is counted. A larger sum is an error.
MAX_LENGTHS = 20_000_000


def fill(counts: np.ndarray, size: int) -> tuple[int, list[tuple[int, int]]]:
    """The fullest content of one bin of a size, from counts by length: (sum, [(length, how many)]).

    Subset-sum over lengths, longest first, each as often as it is at hand: from[s] remembers the length that first
    reached s and how many of it s uses, so the content can be read back.
    """
    lengths = np.flatnonzero(counts)[::-1]
    lengths = lengths[lengths <= size]
    if not len(lengths):
        return 0, []
    by = np.zeros(size + 1, np.int64)  # the length that reached each sum
    reached = np.zeros(size + 1, bool)
    reached[0] = True
    for length in lengths:
        left = int(min(counts[length], size // length))
        fresh = reached.copy()
        frontier = reached
        for _ in range(left):
            moved = np.zeros(size + 1, bool)
            moved[length:] = frontier[: size + 1 - length]
            moved &= ~fresh
            if not moved.any():
                break
            by[moved] = length
            fresh |= moved
            frontier = moved
        reached = fresh
        if reached[size]:
            break
    best = total = int(np.flatnonzero(reached)[-1])
    used: dict[int, int] = {}
    while total:
        length = int(by[total])
        used[length] = used.get(length, 0) + 1
        total -= length
    return best, sorted(used.items(), reverse=True)


def plan(counts: np.ndarray, capacity: int, shares: tuple[float, ...] = SHARES, opening: float = OPENING) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Bins for counts by length: (container length, how often, [(length, how many)]). Every item is in one bin.

    The longest item at hand is placed first in each bin, so none is left over that only an unpractical bin could take.
    """
    counts = counts.astype(np.int64).copy()
    sizes = sorted({max(1, int(capacity * s)) for s in shares} | {capacity})
    out = []
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        best = None
        for size in reversed(sizes):
            # a bin of this size costs at least this much a token; one that can't beat the best is not filled
            if size < longest or best and (size + opening * capacity) / size >= best[0] - 1e-12:
                continue
            total, used = fill(counts, size - longest)
            cost = (size + opening * capacity) / (total + longest)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, used, total + longest)
        counts[longest] += 1
        used = dict(best[1])
        used[longest] = used.get(longest, 0) + 1
        times = int(min(counts[length] // n for length, n in used.items()))
        for length, n in used.items():
            counts[length] -= times * n
        out.append((next(s for s in sizes if s >= best[2]), times, sorted(used.items(), reverse=True)))
    return out


def pack(items: DataFrame, key: str, group: str, size: str, capacities: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """One row per piece of an item: the key, `part` (from 0), `length`, the group, `container_id`, `capacity` (the
    container's length after downsizing).

    items: one row per key. An item longer than its group's capacity is cut into full containers and a rest; no other is.
    capacities: the group column and `capacity`, one row per group. A null or unknown group gets the largest capacity
    given; where no capacity at all is given every item is a container of its own length. Items of size 0 or null get no
    container and no row. Extra columns are left out. Container ids are strings of group and number; empty tables give no
    rows.
    """
    spark = items.sparkSession
    known = capacities.where("capacity > 0").groupBy(F.lower(F.trim(group)).alias("g")).agg(F.max("capacity").alias("c"))
    caps = {g: int(c) for g, c in known.where("g is not null").limit(MAX_LENGTHS + 1).collect()}
    if sum(caps.values()) > MAX_LENGTHS:
        raise ValueError(f"capacities of {sum(caps.values())} lengths together are beyond MAX_LENGTHS")
    kind = items.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, part int, length int, {group} string, container_id string, capacity int"
    if not caps:
        own = items.where(F.col(size) > 0).select(F.col(key), F.lit(0).alias("part"), F.col(size).cast("int").alias("length"), F.lit("").alias(group), F.concat(F.lit("#"), F.col(key).cast("string")).alias("container_id"), F.col(size).cast("int").alias("capacity"))
        return own
    default = max(caps.values())
    name = F.coalesce(F.lower(F.trim(group)), F.lit(""))
    cap = F.coalesce(F.create_map(*[F.lit(x) for g, c in caps.items() for x in (g, c)])[name], F.lit(default))
    sized = items.where(F.col(size) > 0).select(F.col(key).alias("_key"), F.when(name.isin(*caps), name).otherwise("").alias("_group"), F.col(size).cast("long").alias("_size"), cap.cast("long").alias("_cap"))
    pieces = sized.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_size") / F.col("_cap")) - 1)))
    pieces = pieces.withColumn("_length", F.least(F.col("_cap"), F.col("_size") - F.col("_part") * F.col("_cap")).cast("int"))
    counted = pieces.groupBy("_group", "_cap", "_length").count().toArrow()
    rows = list(zip(*(counted.column(i).to_pylist() for i in range(4))))
    # a length that many sequences have is numbered in parts, by the key's hash; most lengths have one part
    salts = {(g, length): -(-n // PART_ROWS) for g, _, length, n in rows if n > PART_ROWS}
    pieces = pieces.withColumn("_salt", F.lit(0))
    parts: dict[tuple[str, int], np.ndarray] = {}
    if salts:
        many = F.broadcast(spark.createDataFrame([(g, length, n) for (g, length), n in salts.items()], "_group string, _length int, _salts int"))  # at most all rows / PART_ROWS
        pieces = pieces.drop("_salt").join(many, ["_group", "_length"], "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_key", "_part"), F.col("_salts")), F.lit(0)).cast("int"))
        for g, length, salt, n in pieces.where("_salts is not null").groupBy("_group", "_length", "_salt").count().collect():
            parts.setdefault((g, length), np.zeros(salts[g, length], np.int64))[salt] = n
    by_group: dict[tuple[str, int], np.ndarray] = {}
    for g, c, length, n in rows:
        by_group.setdefault((g, c), np.zeros(c + 1, np.int64))[length] = n
    starts = {at: np.concatenate(([0], np.cumsum(n)))[:-1] for at, n in parts.items()}
    slots: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}
    for (g, c), counts in sorted(by_group.items()):
        rank: dict[int, int] = {}
        table: dict[int, list[tuple[int, int, int, int]]] = {}
        first = 0
        for container, times, used in plan(counts, c, shares):
            for length, n in used:
                table.setdefault(length, []).append((rank.get(length, 0), n, first, container))
                rank[length] = rank.get(length, 0) + times * n
            first += times
        for length, entries in table.items():
            slots[g, length] = tuple(np.array(x) for x in zip(*entries))

    slots_b = spark.sparkContext.broadcast((starts, slots))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, slots = slots_b.value
        for b in batches:
            d = b.to_pandas()
            container, capacity = np.empty(len(d), object), np.zeros(len(d), np.int32)
            for (g, length), at in d.groupby(["_group", "_length"]).indices.items():
                ranks = d["_rank"].to_numpy()[at] - 1
                if (g, length) in starts:
                    ranks = ranks + starts[g, length][d["_salt"].to_numpy()[at]]
                begin, n, first, size = slots[g, length]
                k = np.searchsorted(begin, ranks, "right") - 1
                number = first[k] + (ranks - begin[k]) // n[k]
                container[at] = [f"{g}#{x}" for x in number]
                capacity[at] = size[k]
            yield pa.RecordBatch.from_pydict({key: b.column("_key"), "part": pa.array(d["_part"], pa.int32()), "length": b.column("_length"), group: b.column("_group"), "container_id": pa.array(container, pa.string()), "capacity": pa.array(capacity)})

    from pyspark.sql import Window

    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("_group", "_length", "_salt").orderBy("_key", "_part")))
    chosen = ranked.select("_key", "_part", "_length", "_group", "_salt", "_rank")
    return chosen.mapInArrow(assign, schema)


def sequence_lengths(rollout: DataFrame) -> DataFrame:
    """row_idx, data_source and size (ids with mask 1), each row_idx once; a null mask counts as size 0."""
    size = F.coalesce(F.size(F.filter("attention_mask", lambda m: m == 1)), F.lit(0))
    return rollout.select("row_idx", "data_source", size.alias("size")).groupBy("row_idx").agg(F.max("data_source").alias("data_source"), F.max("size").alias("size"))


def p3_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every sequence of rollout."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return pack(sequence_lengths(read("rollout")), "row_idx", "data_source", "size", read("token_budgets"))


def p3_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: containers, tokens, room and the share of the room that is filled."""
    placed = p3_containers(spark, sf_dir)
    bins = placed.groupBy("data_source", "container_id").agg(F.max("capacity").alias("room"), F.sum("length").alias("tokens"))
    return bins.groupBy("data_source").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("room").alias("room")).withColumn("filled", F.round(F.col("tokens") / F.col("room"), 6))
