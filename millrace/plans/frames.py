"""Queries on positional batches, over part and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import balance, frame
from millrace.plans.catalogue import register
from millrace.plans.groups import scored
from millrace.session import table

PARTS_SQL = "b AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, p_partkey, p_name, p_size FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.positions(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")


@register("batch_positions", f"WITH {PARTS_SQL} SELECT * FROM b")
def batch_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)


@register("repeat_interleaved", f"WITH {PARTS_SQL} SELECT row_idx * 3 + k AS row_idx, p_partkey, p_name, p_size FROM b, (SELECT unnest(range(3)) AS k)")
def repeat_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.repeat(_parts(spark, sf_dir), 3)


@register("repeat_tiled", f"WITH {PARTS_SQL} SELECT k * (SELECT count(*) FROM b) + row_idx AS row_idx, p_partkey, p_name, p_size FROM b, (SELECT unnest(range(2)) AS k)")
def repeat_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.repeat(_parts(spark, sf_dir), 2, interleave=False)


@register(
    "pad_to_divisor",
    f"""WITH {PARTS_SQL}, n AS (SELECT count(*) AS n, (7 - count(*) % 7) % 7 AS added FROM b)
    SELECT row_idx, p_partkey, p_name, p_size, false AS is_pad FROM b UNION ALL SELECT n + row_idx, p_partkey, p_name, p_size, true FROM b, n WHERE row_idx < added""",
)
def pad_to_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.pad_to_divisor(_parts(spark, sf_dir), 7)[0]


@register("unpadded", f"WITH {PARTS_SQL} SELECT * FROM b")
def unpadded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.unpad(frame.pad_to_divisor(_parts(spark, sf_dir), 7)[0])


@register("chunks", f"WITH {PARTS_SQL} SELECT *, row_idx // ((SELECT count(*) FROM b) // 4) AS chunk_id FROM b")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.chunk(_parts(spark, sf_dir), 4)


@register("fixed_batches", f"WITH {PARTS_SQL} SELECT *, row_idx // 64 AS batch_id FROM b WHERE row_idx // 64 < (SELECT count(*) FROM b) // 64")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.split(_parts(spark, sf_dir), 64, drop_last=True)


@register("reordered", f"WITH {PARTS_SQL} SELECT (SELECT count(*) FROM b) - 1 - row_idx AS row_idx, p_partkey, p_name, p_size FROM b")
def reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _parts(spark, sf_dir)
    n = b.count()
    return frame.reorder(b, b.select(F.col("row_idx").alias("place"), (n - 1 - F.col("row_idx")).alias("at")))


@register("reordered_back", f"WITH {PARTS_SQL} SELECT * FROM b")
def reordered_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rotation and its inverse."""
    b = _parts(spark, sf_dir)
    n = b.count()
    turn = b.select(F.col("row_idx").alias("place"), ((F.col("row_idx") + 7) % n).alias("at"))
    return frame.reorder(frame.reorder(b, turn), frame.inverse(turn))


@register("sliced", f"WITH {PARTS_SQL} SELECT (row_idx - 5) // 3 AS row_idx, p_partkey, p_name, p_size FROM b WHERE row_idx >= 5 AND row_idx < 150 AND (row_idx - 5) % 3 = 0")
def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.cut(_parts(spark, sf_dir), 5, 150, 3)


@register("reversed_slice", f"WITH {PARTS_SQL}, n AS (SELECT count(*) AS n FROM b) SELECT (n - 1 - row_idx) // 2 AS row_idx, p_partkey, p_name, p_size FROM b, n WHERE (n - 1 - row_idx) % 2 = 0")
def reversed_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.cut(_parts(spark, sf_dir), step=-2)


@register("masked_rows", f"WITH {PARTS_SQL} SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, p_partkey, p_name, p_size FROM b WHERE p_size > 25")
def masked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.masked(_parts(spark, sf_dir), F.col("p_size") > 25)


@register("union_columns", f"WITH {PARTS_SQL} SELECT row_idx, p_partkey, p_name, p_size, p_size * 2 AS twice FROM b")
def union_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _parts(spark, sf_dir)
    return frame.union_columns(b, b.select("row_idx", "p_size", (F.col("p_size") * 2).alias("twice")))


@register("concatenated", f"WITH {PARTS_SQL} SELECT * FROM b UNION ALL SELECT (SELECT count(*) FROM b) + row_idx, p_partkey, p_name, p_size FROM b")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _parts(spark, sf_dir)
    return frame.concat([b, b])


@register("folded", f"WITH {PARTS_SQL} SELECT row_idx // ((SELECT count(*) FROM b) // 50) AS row_idx, list(p_size ORDER BY row_idx) AS sizes FROM b GROUP BY 1")
def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.fold(_parts(spark, sf_dir), 50).select("row_idx", F.transform("folded", lambda x: x["p_size"]).alias("sizes"))


@register("unfolded", f"WITH {PARTS_SQL} SELECT * FROM b")
def unfolded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.unfold(frame.fold(_parts(spark, sf_dir), 50))


@register("popped_renamed", f"WITH {PARTS_SQL} SELECT row_idx, p_partkey AS key FROM b")
def popped_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rest = frame.pop(_parts(spark, sf_dir), "p_name", "p_size")
    return frame.rename(rest, ["p_partkey"], ["key"])


@register("percent_split", f"WITH {PARTS_SQL} SELECT row_idx - (SELECT CAST(count(*) * 0.75 AS BIGINT) FROM b) AS row_idx, p_partkey, p_name, p_size FROM b WHERE row_idx >= (SELECT CAST(count(*) * 0.75 AS BIGINT) FROM b)")
def percent_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.percent_split(_parts(spark, sf_dir), 0.75, 1.0)


@register("transposed", "SELECT user_id AS row_idx, list(value ORDER BY event_id) AS value FROM events GROUP BY user_id")
def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("row_idx"), "event_id", "value")
    return frame.transpose(e, "event_id", "value")


@register(
    "shuffled_batches",
    f"""WITH {PARTS_SQL}, c AS (SELECT * FROM b WHERE row_idx < (SELECT count(*) FROM b) // 10 * 10), s AS (SELECT row_number() OVER (PARTITION BY e ORDER BY md5((3 + e) || ':' || row_idx), row_idx) - 1 AS row_idx, p_partkey, p_name, p_size, CAST(e AS INTEGER) AS epoch FROM c, (SELECT unnest(range(2)) AS e))
    SELECT *, row_idx // 10 AS batch_id FROM s""",
)
def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of seeded mini-batches, each in the order of its own hash."""
    b = _parts(spark, sf_dir)
    return frame.mini_batches(frame.cut(b, 0, b.count() // 10 * 10), 10, 2, seed=3)


@register("arithmetic_prompts", "SELECT a * 10000 + b * 100 + c AS id, concat(a, ',', b, ':', c) AS prompt, ((b + (b - a)) % 50 + 50) % 50 AS following FROM range(0, 20) x(a), range(0, 20) y(b), range(5, 8) z(c)")
def arithmetic_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prompts of a synthetic task: one range split by division, so nothing is crossed."""
    from millrace.functions.sequences import arithmetic_sequence

    i = spark.range(20 * 20 * 3).select((F.col("id") % 20).alias("a"), (F.expr("id div 20") % 20).alias("b"), (F.expr("id div 400") + 5).alias("c"))
    follow = F.get(arithmetic_sequence(F.col("a"), F.col("b"), 1, 50), F.lit(0))
    return i.select((F.col("a") * 10000 + F.col("b") * 100 + F.col("c")).alias("id"), F.concat(F.col("a").cast("string"), F.lit(","), F.col("b").cast("string"), F.lit(":"), F.col("c").cast("string")).alias("prompt"), follow.cast("long").alias("following"))


@register("balanced_partitions")
def balanced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts of each step over four workers by differencing. Sequential, so without SQL; property tests hold it."""
    r = _steps(spark, sf_dir)
    return balance.partition(r, "step", "row_idx", "len", 4)


@register("token_budget_batches")
def token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.token_budget(_steps(spark, sf_dir), "step", "row_idx", "len", 2048)


@register(
    "imbalance_before",
    """WITH d AS (SELECT row_idx, any_value(step) AS step, any_value(list_sum(list_slice(attention_mask, 81, 240))) AS len FROM rollout GROUP BY row_idx), r AS (SELECT step, len, row_number() OVER (PARTITION BY step ORDER BY row_idx) - 1 AS k, count(*) OVER (PARTITION BY step) AS n FROM d),
    p AS (SELECT step, k // CAST(ceil(n / 4) AS BIGINT) AS part, sum(len) AS load FROM r WHERE n >= 4 GROUP BY ALL) SELECT step, CAST(min(load) AS BIGINT) AS min, CAST(max(load) AS BIGINT) AS max, round(avg(load), 6) AS mean, CAST(max(load) - min(load) AS BIGINT) AS diff FROM p GROUP BY step""",
)
def imbalance_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of consecutive parts, before any balancing."""
    r = _steps(spark, sf_dir).withColumn("part", F.lit(0))
    return balance.imbalance(r, "step", "row_idx", "len", "part", 4).select("step", "min", "max", F.round("mean", 6).alias("mean"), "diff")


@register("balance_report")
def balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _steps(spark, sf_dir)
    parts = balance.partition(r, "step", "row_idx", "len", 4)
    return balance.imbalance(r.join(parts, ["step", "row_idx"]), "step", "row_idx", "len", "part", 4)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "rollout").groupBy("row_idx").agg(F.first("step").alias("step"))
    r = scored(spark, sf_dir).select("row_idx", "len").join(steps, "row_idx")
    n = r.groupBy("step").count().where("count >= 4").select("step")
    return r.join(n, "step", "left_semi")


@register("collated_rows", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'a', CAST(1 AS BIGINT)), (1, 'b', 2)) t(row_idx, k, n)")
def collated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.collate(spark, [{"k": "a", "n": 1}, {"k": "b", "n": 2, "extra": 3}], "k string, n long")


@register("saved_batch", f"WITH {PARTS_SQL} SELECT * FROM b")
def saved_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from millrace.session import shared_dir

    at = f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}"
    frame.save(_parts(spark, sf_dir), at)
    return frame.load(spark, at)


@register(
    "rank_samples",
    f"""WITH {PARTS_SQL}, n AS (SELECT count(*) AS n, (7 - count(*) % 7) % 7 AS added FROM b), p AS (SELECT row_idx, p_partkey FROM b UNION ALL SELECT n + row_idx, p_partkey FROM b, n WHERE row_idx < added)
    SELECT row_idx // 7 AS row_idx, p_partkey FROM p WHERE row_idx % 7 = 3""",
)
def rank_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators import datasets

    return datasets.rank_sample(_parts(spark, sf_dir).select("row_idx", "p_partkey"), 7, 3).select("row_idx", "p_partkey")


@register("shuffled_options", "SELECT item_id, list_transform(list_sort(list_transform(options, lambda o: {'h': md5('5:' || item_id || ':' || o), 'o': o})), lambda x: x.o) AS shuffled FROM eval_items WHERE options IS NOT NULL")
def shuffled_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators import datasets

    i = table(spark, sf_dir, "eval_items").where("options is not null").select("item_id", "options", "answer")
    return datasets.shuffled_options(i, "item_id", "options", "answer", 5).select("item_id", "shuffled")


@register("reduced_values", "SELECT event_type, round(max(value) - min(value), 6) AS spread, round(median(value), 6) AS middle FROM events GROUP BY event_type")
def reduced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own reducers of each group's values."""
    from millrace.operators import validation

    e = table(spark, sf_dir, "events").select("event_type", "value")
    out = validation.reduced(e, ["event_type"], "value", {"spread": lambda v: v.max() - v.min(), "middle": lambda v: sorted(v)[len(v) // 2] if len(v) % 2 else sum(sorted(v)[len(v) // 2 - 1 : len(v) // 2 + 1]) / 2})
    return out.select("event_type", F.round("spread", 6).alias("spread"), F.round("middle", 6).alias("middle"))


@register(
    "task_rows",
    """WITH i AS (SELECT question, answer, solution, options, category, CAST(item_id AS BIGINT) AS k FROM eval_items), a AS (SELECT 'numbers' AS data_source, k, question || ' Think.' AS content, nullif(regexp_replace(regexp_extract(answer, '#### (\\-?[0-9\\.\\,]+)', 1), '[,$]', '', 'g'), '') AS truth FROM i),
    b AS (SELECT 'choice' AS data_source, k, question || chr(10) || coalesce(array_to_string(list_transform(list_zip(options[1:10], range(len(options[1:10]))), lambda p: '(' || chr(CAST(65 + p[2] AS INTEGER)) || '): ' || p[1] || chr(10)), ''), '') || 'Pick one.' AS content, answer AS truth FROM i WHERE options IS NOT NULL), c AS (SELECT 'preference' AS data_source, k, question AS content, solution AS truth FROM i)
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three registered tasks over the same items, flattened to compare."""
    from millrace.operators import datasets as D

    tasks = D.Tasks()
    tasks.add("numbers", ("question", "answer", "index"), lambda df: D.hash_numbers(df, "Think.", "test"))
    tasks.add("choice", ("question", "options", "letter", "index"), lambda df: D.with_options(df, "Pick one.", "test"))
    tasks.add("preference", ("prompt", "chosen", "index"), lambda df: D.preferred(df, "test"))
    i = table(spark, sf_dir, "eval_items").withColumn("index", F.col("item_id").cast("long"))
    parts = [tasks.build("numbers", i), tasks.build("choice", i.where("options is not null").withColumn("letter", F.col("answer"))), tasks.build("preference", i.select("index", F.col("question").alias("prompt"), F.col("solution").alias("chosen")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("data_source", F.col("extra_info.index").alias("k"), F.get("prompt", F.lit(0))["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"))
