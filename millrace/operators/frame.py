"""The algebra of positional batches over DataFrames.

A batch is a DataFrame with one row per position and the position in a long column `row_idx` from 0; nothing relies on
physical order. Every function returns a batch whose positions are again 0, 1, 2, ... A null position is an error of the
caller's; empty batches give empty batches. Other columns are carried along untouched, nulls included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import written

IDX = "row_idx"


def positions(df: DataFrame, *order: str | Column, name: str = IDX) -> DataFrame:
    """df with positions by the order given, which must be total for the result to be the same each time.

    The rows are range-partitioned and sorted once; each partition is numbered on its own and shifted by the sizes of
    those before it, so no task holds all rows. The numbered rows are written to the shared folder: were they computed
    twice, partitions might be merged otherwise the second time, and numbers would no longer fit.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)), "positions")
    sizes = ordered.groupBy("_part").agg((F.max("_at") + 1).alias("_size"))
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row a partition: its size is that of the task list
    return ordered.join(F.broadcast(shifts.select("_part", "_shift")), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def from_columns(spark: SparkSession, columns: dict[str, list], schema: str | T.StructType) -> DataFrame:
    """A batch from lists of equal length; unequal lengths are an error."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise ValueError(f"columns of unequal lengths {sorted(lengths)}")
    rows = list(zip(range(lengths.pop() if lengths else 0), *columns.values()))
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame(rows, T.StructType([T.StructField(IDX, T.LongType(), False), *kinds.fields]))


def collate(spark: SparkSession, rows: list[dict], schema: str | T.StructType) -> DataFrame:
    """A batch from a list of records: the keys of the first count, every record must have them, others are left out."""
    if not rows:
        return from_columns(spark, {f.name: [] for f in (T._parse_datatype_string(schema) if isinstance(schema, str) else schema)}, schema)
    return from_columns(spark, {k: [r[k] for r in rows] for k in rows[0]}, schema)


def save(df: DataFrame, path: str) -> None:
    """The batch with its positions as Parquet, in place of what was there."""
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if IDX not in df.columns:
        raise ValueError(f"{path} holds no batch: no column {IDX}")
    return df


def length(df: DataFrame | None) -> int:
    """Rows of a batch; none for no batch."""
    return 0 if df is None else df.count()


def gather(df: DataFrame, wanted: DataFrame, at: str = "at", place: str = "place") -> DataFrame:
    """Rows at the positions in `wanted` (columns: place from 0, at), in that order, repeats included.

    A position outside the batch is an error when the result is computed.
    """
    picks = wanted.select(F.col(place).cast("long").alias("_place"), F.col(at).cast("long").alias("_at"))
    joined = picks.join(df.withColumn("_there", F.lit(True)), picks["_at"] == df[IDX], "left")
    there = F.when(F.col("_there"), F.col("_place")).otherwise(F.raise_error(F.concat(F.lit("no row at position "), F.col("_at").cast("string"))).cast("long"))
    return joined.withColumn(IDX, there).drop("_place", "_at", "_there")


def reorder(df: DataFrame, permutation: DataFrame) -> DataFrame:
    """As gather, for a permutation."""
    return gather(df, permutation)


def inverse(permutation: DataFrame, at: str = "at", place: str = "place") -> DataFrame:
    """The permutation that undoes one."""
    return permutation.select(F.col(at).alias(place), F.col(place).alias(at))


def cut(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Positions start, start + step, ... before stop; negative bounds count from the end as in a slice. With a negative step a
    start of 0 means the end."""
    if step == 0:
        raise ValueError("step must not be 0")
    if step < 0:  # backwards from start, as [::-1] does
        n = df.count()
        places = range(n)[slice(None if start == 0 else start, stop, step)]
        if not len(places):
            return df.limit(0)
        at = F.col(IDX)
        inside = at.between(places[-1], places[0]) & ((F.lit(places[0]) - at) % -step == 0)
        return df.where(inside).withColumn(IDX, F.expr(f"({places[0]} - {IDX}) div {-step}"))
    if start < 0 or stop is not None and stop < 0:
        n = df.count()
        start = max(0, start + n) if start < 0 else start
        stop = max(0, stop + n) if stop is not None and stop < 0 else stop
    keep = (F.col(IDX) >= start) & ((F.col(IDX) - start) % step == 0)
    if stop is not None:
        keep &= F.col(IDX) < stop
    return df.where(keep).withColumn(IDX, F.expr(f"({IDX} - {start}) div {step}"))


def masked(df: DataFrame, mask: Column) -> DataFrame:
    """Rows whose mask is true, positions closed up; null counts as false."""
    return positions(df.where(mask).withColumnRenamed(IDX, "_was"), "_was").drop("_was")


def select(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(IDX, *columns)


def pop(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest); a missing name is an error."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise KeyError(f"no columns {sorted(missing)}")
    return df.select(IDX, *columns), df.drop(*columns)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both batches by position. Columns of both must be equal everywhere (NaN equals NaN, null equals null)
    and the batches of one size; else an error when the result is computed."""
    shared = [c for c in b.columns if c in a.columns and c != IDX]
    right = b.select(F.col(IDX).alias("_idx"), *[F.col(c).alias(f"_b_{c}") for c in shared], *[c for c in b.columns if c not in shared and c != IDX])
    joined = a.join(right, a[IDX] == right["_idx"], "full")
    same = reduce(lambda x, y: x & y, (joined[c].eqNullSafe(joined[f"_b_{c}"]) for c in shared), F.lit(True))
    sized = joined[IDX].isNotNull() & joined["_idx"].isNotNull()
    checked = F.when(~sized, F.raise_error(F.lit("batches of unequal sizes")).cast("long")).when(~same, F.raise_error(F.lit(f"columns of both batches differ: {shared}")).cast("long")).otherwise(joined[IDX])
    return joined.withColumn(IDX, checked).drop("_idx", *[f"_b_{c}" for c in shared])


def concat(batches: list[DataFrame]) -> DataFrame:
    """Rows of all batches one after another; names must agree."""
    if not batches:
        raise ValueError("no batches")
    out, shift = batches[0], batches[0].count()
    for b in batches[1:]:
        out = out.unionByName(b.withColumn(IDX, F.col(IDX) + shift))
        shift += b.count()
    return out


def chunk(df: DataFrame, chunks: int) -> DataFrame:
    """`chunk_id` from 0 for chunks of equal size; sizes that don't divide are an error."""
    n = df.count()
    if chunks < 1 or n % chunks:
        raise ValueError(f"{n} rows don't divide into {chunks} chunks")
    return df.withColumn("chunk_id", F.expr(f"{IDX} div {max(n // chunks, 1)}"))


def split(df: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """`batch_id` from 0 for batches of a fixed size; the last may be short, or is dropped."""
    out = df.withColumn("batch_id", F.expr(f"{IDX} div {size}"))
    return out.where(F.col("batch_id") < df.count() // size) if drop_last else out


def repeat(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Each row `times` times: a, a, b, b if interleaved, else a, b, a, b."""
    spread = df.withColumn("_rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))) if times > 0 else F.explode(F.array().cast("array<long>")))
    place = F.col(IDX) * times + F.col("_rep") if interleave else F.col("_rep") * df.count() + F.col(IDX)
    return spread.withColumn(IDX, place).drop("_rep")


def pad_to_divisor(df: DataFrame, divisor: int) -> tuple[DataFrame, int]:
    """(the batch with leading rows recycled at its end until the divisor divides it, rows added). Padded rows have
    is_pad true. An empty batch is not padded."""
    n = df.count()
    added = -n % divisor if n else 0
    out = df.withColumn("is_pad", F.lit(False))
    if added:
        more = df.where(F.col(IDX) < min(added, n)).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit((added - 1) // n))))
        more = more.withColumn(IDX, F.lit(n) + F.col("_round") * n + F.col(IDX)).where(F.col(IDX) < n + added).drop("_round")
        out = out.unionByName(more.withColumn("is_pad", F.lit(True)))
    return out, added


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def fold(df: DataFrame, rows: int) -> DataFrame:
    """`rows` rows, each with the array `folded` of the structs of as many consecutive rows as divide them."""
    n = df.count()
    if rows < 1 or n % rows:
        raise ValueError(f"{n} rows don't fold into {rows}")
    each = max(n // rows, 1)
    others = [c for c in df.columns if c != IDX]
    return df.groupBy(F.expr(f"{IDX} div {each}").alias(IDX)).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(IDX).alias("_at"), F.struct(*others).alias("_row")))), lambda x: x["_row"]).alias("folded"))


def unfold(df: DataFrame) -> DataFrame:
    """Undoes fold; all rows must hold as many."""
    each = F.size("folded")
    return df.select(IDX, F.posexplode("folded").alias("_at", "_row"), each.alias("_n")).select((F.col(IDX) * F.col("_n") + F.col("_at")).alias(IDX), "_row.*")


def transpose(df: DataFrame, sample: str, value: str) -> DataFrame:
    """From rows (row_idx, sample, value) to row_idx with `value` as an array by sample."""
    return df.groupBy(IDX).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(value).alias("v")))), lambda x: x["v"]).alias(value))


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """The rows in an order drawn by a hash of seed and position: the same each time and on any cluster."""
    return positions(df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(IDX).cast("string")))).withColumnRenamed(IDX, "_was"), "_h", "_was").drop("_h", "_was")


def mini_batches(df: DataFrame, size: int, epochs: int, seed: int | None = None) -> DataFrame:
    """`epoch` and `batch_id`: the rows once an epoch, in the epoch's own order if a seed is given; sizes that don't
    divide are an error."""
    n = df.count()
    if size < 1 or n % size:
        raise ValueError(f"{n} rows don't divide into batches of {size}")
    out = []
    for e in range(epochs):
        rows = df if seed is None else shuffled(df, seed + e)
        out.append(rows.withColumn("epoch", F.lit(e)).withColumn("batch_id", F.expr(f"{IDX} div {size}")))
    return reduce(DataFrame.unionByName, out)


def sizes(df: DataFrame) -> DataFrame:
    """`bytes`, about: the lengths of all values as text, in one row."""
    return df.agg(*[F.sum(F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0))).alias(f"_{i}") for i, c in enumerate(df.columns)]).select(reduce(lambda a, b: a + b, (F.col(f"_{i}") for i in range(len(df.columns)))).alias("bytes"))


def percent_split(df: DataFrame, start: float, stop: float) -> DataFrame:
    """Rows from a share of the positions to another, as train[:75%] and train[75%:] do; bounds are rounded."""
    n = df.count()
    a, b = round(n * start), round(n * stop)
    return df.where((F.col(IDX) >= a) & (F.col(IDX) < b)).withColumn(IDX, F.col(IDX) - a)
