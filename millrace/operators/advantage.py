"""Advantages of responses: relative to their group, or along their tokens.

A group is all rows of one prompt. Group figures come from an aggregate that is combined before its shuffle and joined
back, so that a group holding a third of all rows never meets in one task. Null groups form a group of their own; null
scores are left out of the group figures and get a null advantage. Names of a table that begin with _g_ would clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import ragged
from millrace.session import written

EPSILON = 1e-6


def with_group_figures(df: DataFrame, group: str, score: str) -> DataFrame:
    """df with _g_n, _g_mean and _g_std (sample) of the score in each group."""
    figures = df.groupBy(F.col(group).alias("_g_key")).agg(F.count(score).alias("_g_n"), F.avg(score).alias("_g_mean"), F.stddev_samp(score).alias("_g_std"))
    return df.join(figures, df[group].eqNullSafe(figures["_g_key"]), "left").drop("_g_key")


def _with(df: DataFrame, group: str, score: str, value: Column) -> DataFrame:
    return with_group_figures(df, group, score).withColumn("advantage", value).drop("_g_n", "_g_mean", "_g_std")


def grpo(df: DataFrame, group: str, score: str, epsilon: float = EPSILON) -> DataFrame:
    """(s - mean) / (sample deviation + epsilon); a single row counts as mean 0 and deviation 1."""
    s = F.col(score)
    return _with(df, group, score, F.when(F.col("_g_n") == 1, s / (1 + epsilon)).otherwise((s - F.col("_g_mean")) / (F.col("_g_std") + epsilon)))


def rloo(df: DataFrame, group: str, score: str) -> DataFrame:
    """(s - mean of the others); a single row keeps its score."""
    s, n = F.col(score), F.col("_g_n")
    return _with(df, group, score, F.when(n == 1, s).otherwise((s - F.col("_g_mean")) * n / F.nullif(n - 1, F.lit(0))))


def baseline(df: DataFrame, group: str, score: str) -> DataFrame:
    """s - mean; a single row keeps its score."""
    s = F.col(score)
    return _with(df, group, score, F.when(F.col("_g_n") == 1, s).otherwise(s - F.col("_g_mean")))


def whitened(df: DataFrame, value: str, weight: str | None = None, shift_mean: bool = True) -> DataFrame:
    """df with `whitened`: (v - mean) / sqrt(variance + 1e-8) over the whole table, each value `weight` times (tokens).

    The mean is the weighted sum by the weights' sum + 1e-8, the variance is Bessel-corrected; with fewer than
    two tokens the result is null.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    v = F.col(value)
    known = df.where(v.isNotNull())
    mean = known.agg(F.sum(v * w) / (F.sum(w) + 1e-8)).scalar()  # a scalar subquery: one value, no join
    n = F.sum(w)
    var = known.agg(F.when(n > 1, F.sum((v - mean) ** 2 * w) / (n + 1e-8) * n / F.nullif(n - 1, F.lit(0.0)))).scalar()
    out = (v - mean) / F.sqrt(var + 1e-8)
    return df.withColumn("whitened", out if shift_mean else out + mean)


def spread_over(mask: str) -> Callable[[Column], Column]:
    """A scalar advantage on every token of the mask."""
    return lambda a: F.transform(F.col(mask), lambda m: m.cast("double") * a)


def remax_returns(rewards: str, mask: str) -> Column:
    """Reverse running sum of rewards over the mask."""
    return ragged.fold(lambda r, m: ragged.reverse_cumsum(r * m), rewards, mask)


def remax(rewards: str, mask: str, reference: str) -> Column:
    """remax_returns less the reference's score, over the mask."""
    return F.zip_with(remax_returns(rewards, mask), F.transform(mask, lambda m: F.struct(m.cast("double").alias("m"), F.col(reference).alias("b"))), lambda r, p: r - p["b"] * p["m"])


def discounted_returns(rewards: str, mask: str, gamma: float) -> Column:
    """Returns that a 0 of the mask cuts off."""
    return ragged.fold(lambda r, m: ragged.discounted(r, gamma, m), rewards, mask)


def general_advantage(rewards: str, values: str, gamma: float, lam: float) -> Column:
    """Generalised advantages, before whitening; returns are these plus the values."""
    return ragged.fold(lambda r, v: ragged.general_advantage(r, v, gamma, lam), rewards, values)


def weighted_rloo(df: DataFrame, position: str, samples: int, rewards: dict[str, float]) -> DataFrame:
    """Leave-one-out over consecutive groups of `samples` rows, for several scores of a row (as masked means of its token
    rewards) with weights: the weighted sum of (own score - mean of the others'), as `advantage`."""
    out = df.withColumn("_g_at", F.expr(f"{position} div {samples}"))
    figures = out.groupBy(F.col("_g_at").alias("_g_key")).agg(*[f(c).alias(f"_g_{n}{i}") for i, c in enumerate(rewards) for n, f in (("s", F.sum), ("n", F.count))])
    out = out.join(figures, F.col("_g_at") == F.col("_g_key"))
    value = F.lit(0.0)
    for i, (c, weight) in enumerate(rewards.items()):
        others = (F.col(f"_g_s{i}") - F.col(c)) / F.nullif(F.col(f"_g_n{i}") - 1, F.lit(0))
        value = value + weight * (F.col(c) - F.coalesce(others, F.lit(0.0)))
    return out.withColumn("advantage", value).select(*df.columns, "advantage")


#: Estimators along the tokens by name: each gives df `advantages` and `returns`, arrays over the response.
TOKEN = ("gae", "reinforce_plus_plus", "remax")


def token_advantage(df: DataFrame, estimator: str, rewards: str, mask: str, values: str | None = None, reference: str | None = None, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """df with `returns` and `advantages` of each token. gae needs values, remax the reference's score. What gae and
    reinforce_plus_plus give is whitened over the masked tokens of the table where `whiten_tokens` is called next."""
    if estimator == "gae":
        raw = general_advantage(rewards, values, gamma, lam)
        return df.withColumn("advantages", raw).withColumn("returns", F.zip_with("advantages", values, lambda a, v: a + v))
    if estimator == "reinforce_plus_plus":
        return df.withColumn("returns", discounted_returns(rewards, mask, gamma)).withColumn("advantages", F.col("returns"))
    if estimator == "remax":
        made = df.withColumn("returns", remax_returns(rewards, mask))
        pairs = F.transform(F.col(mask), lambda m: m.cast("double") * F.col(reference))
        return made.withColumn("advantages", F.zip_with("returns", pairs, lambda r, b: r - b))
    raise ValueError(f"no estimator {estimator}; there are {sorted(TOKEN)}")


def whiten_tokens(df: DataFrame, values: str, mask: str) -> DataFrame:
    """`values` whitened over all masked tokens of the table, and cut to the mask: moments of rows add up, so no token is
    shuffled."""
    moments = F.aggregate(F.zip_with(values, mask, lambda v, m: F.struct(v.alias("v"), m.cast("double").alias("m"))), F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["n"] + x["m"]).alias("n"), (a["s"] + x["m"] * x["v"]).alias("s"), (a["q"] + x["m"] * x["v"] * x["v"]).alias("q")))
    m = df.select(moments.alias("m")).where("m is not null")
    n, s, q = F.sum("m.n"), F.sum("m.s"), F.sum("m.q")
    mean = m.agg(s / (n + 1e-8)).scalar()
    var = m.agg((q - 2 * mean * s + mean * mean * n) / (n + 1e-8) * n / (n - 1)).scalar()
    scaled = df.withColumn("_mean", mean).withColumn("_scale", F.sqrt(var + 1e-8))
    return scaled.withColumn(values, F.zip_with(values, mask, lambda v, k: (v - F.col("_mean")) / F.col("_scale") * k.cast("double"))).drop("_mean", "_scale")


#: Estimators over the outcome score by name.
OUTCOME = {"grpo": grpo, "rloo": rloo, "reinforce_plus_plus_baseline": baseline}


def outcome_advantage(df: DataFrame, estimator: str, group: str, score: str) -> DataFrame:
    """The estimator's advantage of each row; an unknown name is an error."""
    if estimator not in OUTCOME:
        raise ValueError(f"no estimator {estimator}; there are {sorted(OUTCOME)}")
    return OUTCOME[estimator](df, group, score)


def varied_groups(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows of groups whose metric varies (population deviation above 0) or that have one row."""
    figures = df.groupBy(F.col(group).alias("_g_key")).agg(F.stddev_pop(metric).alias("_g_std"), F.count("*").alias("_g_n"))
    kept = figures.where("_g_std > 0 or _g_n = 1").select("_g_key")
    return df.join(kept, df[group].eqNullSafe(kept["_g_key"]), "left_semi")


def band_groups(df: DataFrame, group: str, accuracy: str, low: float, high: float, length: str | None = None, longest: int | None = None) -> DataFrame:
    """`keep` for each row: its group's mean accuracy lies in [low, high] and its longest response stays below longest - 1."""
    figures = [F.avg(accuracy).alias("_g_acc")] + ([F.max(length).alias("_g_len")] if length else [])
    by = df.groupBy(F.col(group).alias("_g_key")).agg(*figures)
    keep = F.col("_g_acc").between(low, high)
    if length and longest is not None:
        keep &= F.col("_g_len") < longest - 1
    return df.join(by, df[group].eqNullSafe(by["_g_key"]), "left").withColumn("keep", F.coalesce(keep, F.lit(False))).drop("_g_key", "_g_acc", "_g_len")


def opposed_pairs(df: DataFrame, group: str, score: str, length: str) -> DataFrame:
    """group, pairs, opposed: of all pairs of rows of a group, those in which the higher score has the lesser length or both
    are equal. Groups of one row have no pair. Lengths are whole numbers from 0; a null one agrees with nothing.

    No row meets another: rows become counts of (score, length), and a length is greater than another where the first bit
    that differs is set, so each bit asks for running sums over the scores of those that have the higher bits in common.
    """
    cells = written(df.groupBy(group, F.col(score).alias("_s"), F.col(length).cast("long").alias("_l")).agg(F.count("*").alias("_n")), "cells")
    n = F.col("_n")
    equal = F.when(F.col("_l").isNotNull() & ~F.isnan("_s"), n * (n - 1) / 2).otherwise(0.0).cast("long")
    by = cells.groupBy(group).agg(F.sum("_n").alias("_all"), F.sum(equal).alias("_equal"))
    bits = int(cells.agg(F.max("_l")).first()[0] or 0).bit_length()
    split = cells.where(F.col("_l").isNotNull() & ~F.isnan("_s")).withColumn("_bit", F.explode(F.array(*[F.lit(b) for b in range(bits)]) if bits else F.array().cast("array<int>")))
    is_set = F.expr("shiftright(_l, _bit) & 1") == 1
    split = split.groupBy(group, "_bit", F.expr("shiftright(_l, _bit + 1)").alias("_head"), "_s").agg(F.sum(F.when(is_set, n).otherwise(0)).alias("_longer"), F.sum(F.when(is_set, 0).otherwise(n)).alias("_shorter"))
    worse = Window.partitionBy(group, "_bit", "_head").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    met = split.withColumn("_met", F.col("_shorter") * F.coalesce(F.sum("_longer").over(worse), F.lit(0)))
    met = met.groupBy(F.col(group).alias("_group")).agg(F.sum("_met").alias("_met"))
    every = by.join(met, F.col(group).eqNullSafe(F.col("_group")), "left").where("_all > 1")
    pairs = F.when(F.col("_all") % 2 == 0, F.expr("_all div 2") * (F.col("_all") - 1)).otherwise(F.expr("(_all - 1) div 2") * F.col("_all"))
    return every.select(group, pairs.alias("pairs"), (F.col("_equal") + F.coalesce("_met", F.lit(0))).alias("opposed"))
