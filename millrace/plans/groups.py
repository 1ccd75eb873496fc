"""Queries on group-relative advantages and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import sequences as Q
from millrace.operators import advantage as A
from millrace.plans.catalogue import register
from millrace.session import table

#: Rollouts once each, with the outcome score; a null array of token scores has a null score.
ROLLOUT_SQL = """r AS (SELECT row_idx, any_value(uid) AS uid, any_value(lower(data_source)) AS data_source, any_value(list_sum(token_level_scores)) AS score,
any_value(list_sum(list_slice(attention_mask, 81, 240))) AS len FROM rollout GROUP BY row_idx)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, uid, data_source (lower case), score (sum of token scores), len (visible tokens) of each rollout, once."""
    r = table(spark, sf_dir, "rollout").select("row_idx", "uid", F.lower("data_source").alias("data_source"), Q.total("token_level_scores").alias("score"), Q.total(Q.response_mask("attention_mask", "responses")).cast("int").alias("len"))
    return r.groupBy("row_idx").agg(*[F.first(c).alias(c) for c in ("uid", "data_source", "score", "len")])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


@register(
    "grpo_advantage",
    """SELECT event_id, round(CASE WHEN n = 1 THEN value / (1 + 1e-6) ELSE (value - m) / (s + 1e-6) END, 6) AS advantage
    FROM (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id))""",
)
def grpo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.outcome_advantage(_events(spark, sf_dir), "grpo", "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@register(
    "rloo_advantage",
    """SELECT event_id, round(CASE WHEN n = 1 THEN value ELSE (value - m) * n / (n - 1) END, 6) AS advantage
    FROM (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id))""",
)
def rloo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.outcome_advantage(_events(spark, sf_dir), "rloo", "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@register(
    "baseline_advantage",
    """WITH a AS (SELECT event_id, CASE WHEN count(value) OVER w = 1 THEN value ELSE value - avg(value) OVER w END AS v FROM events WINDOW w AS (PARTITION BY user_id)),
    m AS (SELECT sum(v) / (count(v) + 1e-8) AS m, count(v) AS n FROM a WHERE v IS NOT NULL),
    q AS (SELECT any_value(m) AS m, sum((v - m) ** 2) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS v FROM a, m)
    SELECT event_id, round((a.v - q.m) / sqrt(q.v + 1e-8), 6) AS whitened FROM a, q""",
)
def baseline_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.outcome_advantage(_events(spark, sf_dir), "reinforce_plus_plus_baseline", "user_id", "value")
    return A.whitened(a, "advantage").select("event_id", F.round("whitened", 6).alias("whitened"))


@register(
    "rollout_grpo",
    f"""WITH {ROLLOUT_SQL} SELECT row_idx, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (s + 1e-6) END, 5) AS advantage
    FROM (SELECT row_idx, score, count(score) OVER w AS n, avg(score) OVER w AS m, stddev_samp(score) OVER w AS s FROM r WINDOW w AS (PARTITION BY uid))""",
)
def rollout_grpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grpo(scored(spark, sf_dir), "uid", "score").select("row_idx", F.round("advantage", 5).alias("advantage"))


@register("outcome_scores", f"WITH {ROLLOUT_SQL} SELECT row_idx, round(score, 6) AS score, CAST(len AS INTEGER) AS len FROM r")
def outcome_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("row_idx", F.round("score", 6).alias("score"), "len")


@register(
    "dynamic_sampling_filter",
    f"""WITH {ROLLOUT_SQL}, g AS (SELECT uid FROM r GROUP BY uid HAVING stddev_pop(score) > 0 OR count(*) = 1)
    SELECT row_idx FROM r JOIN g ON r.uid IS NOT DISTINCT FROM g.uid""",
)
def dynamic_sampling_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.varied_groups(scored(spark, sf_dir), "uid", "score").select("row_idx")


@register(
    "accuracy_band_filter",
    f"""WITH {ROLLOUT_SQL}, g AS (SELECT uid, avg(CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END) AS acc, max(len) AS longest FROM r GROUP BY uid)
    SELECT row_idx, coalesce(acc BETWEEN 0.2 AND 0.8 AND longest < 159, false) AS keep FROM r JOIN g ON r.uid IS NOT DISTINCT FROM g.uid""",
)
def accuracy_band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scored(spark, sf_dir).withColumn("acc", F.when(F.col("score") > 0.5, 1.0).otherwise(0.0))
    return A.band_groups(r, "uid", "acc", 0.2, 0.8, "len", 160).select("row_idx", "keep")


@register(
    "oversample_cut",
    """WITH g AS (SELECT user_id, stddev_pop(value) > 27 AS pass FROM events GROUP BY user_id)
    SELECT user_id, pass FROM (SELECT user_id, pass, row_number() OVER (ORDER BY pass DESC, user_id) AS k, count(*) OVER () AS n FROM g) WHERE k <= n // 2""",
)
def oversample_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing groups first, then the others, cut to half of all: a global order with a limit."""
    g = _events(spark, sf_dir).groupBy("user_id").agg((F.stddev_pop("value") > 27).alias("pass"))
    return g.orderBy(F.desc("pass"), "user_id").limit(g.count() // 2)


@register(
    "pairwise_preference",
    f"""WITH {ROLLOUT_SQL}, f AS (SELECT * FROM r WHERE score IS NOT NULL AND uid IS NOT NULL)
    SELECT a.uid, CAST(count(*) AS BIGINT) AS pairs, round(avg(CASE WHEN sign(a.score - b.score) = sign(CAST(b.len AS INTEGER) - CAST(a.len AS INTEGER)) THEN 1.0 ELSE 0.0 END), 6) AS agreement
    FROM f a JOIN f b ON a.uid = b.uid AND a.row_idx < b.row_idx GROUP BY a.uid""",
)
def pairwise_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs i < j of the responses of a prompt: how often the better score goes with the shorter response, and equal
    scores with equal lengths."""
    r = scored(spark, sf_dir).where("score is not null and uid is not null")
    return A.opposed_pairs(r, "uid", "score", "len").select("uid", "pairs", F.round(F.col("opposed") / F.col("pairs"), 6).alias("agreement"))


@register(
    "better_siblings",
    f"""WITH {ROLLOUT_SQL}, s AS (SELECT DISTINCT uid, score FROM r WHERE uid IS NOT NULL AND score IS NOT NULL),
    t AS (SELECT uid, score, sum(len) AS len, count(*) AS n FROM r WHERE uid IS NOT NULL AND score IS NOT NULL GROUP BY uid, score),
    c AS (SELECT uid, score, sum(len) OVER w AS len, sum(n) OVER w AS n FROM t WINDOW w AS (PARTITION BY uid ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT r.row_idx, round(c.len / c.n, 6) AS worse_mean FROM r JOIN c ON r.uid = c.uid AND r.score = c.score""",
)
def better_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row the mean length of its prompt's worse rows. Running sums over distinct scores, not a join of rows with
    rows: a prompt of n rows costs n and not n * n."""
    from pyspark.sql import Window

    r = scored(spark, sf_dir).where("uid is not null and score is not null")
    t = r.groupBy("uid", "score").agg(F.sum("len").alias("len"), F.count("*").alias("n"))
    w = Window.partitionBy("uid").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    c = t.select("uid", "score", (F.sum("len").over(w) / F.sum("n").over(w)).alias("worse"))
    return r.join(c, ["uid", "score"]).select("row_idx", F.round("worse", 6).alias("worse_mean"))
