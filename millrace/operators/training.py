"""Pieces of a training step that are data processing: row assembly, preference losses, controllers, dispatch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import ragged
from millrace.functions import sequences as Q


class FixedController:
    """A divergence weight that stays."""

    def __init__(self, beta: float) -> None:
        self.beta = beta

    def update(self, current: float, steps: int) -> float:
        return self.beta


class AdaptiveController(FixedController):
    """A divergence weight that follows a target: the relative miss, at most a fifth either way, moves it in proportion to
    the steps taken over the horizon."""

    def __init__(self, beta: float, target: float, horizon: float) -> None:
        super().__init__(beta)
        self.target, self.horizon = target, horizon

    def update(self, current: float, steps: int) -> float:
        miss = min(max(current / self.target - 1, -0.2), 0.2)
        self.beta *= 1 + miss * steps / self.horizon
        return self.beta


def rollout_rows(df: DataFrame, prompt: str, response: str, mask: str, end: int | list[int]) -> DataFrame:
    """df with input_ids (prompt then response), attention_mask (the prompt's, then 1 up to the first end token) and
    position_ids (running over the prompt, then on by one each)."""
    full = F.concat(F.col(mask).cast("array<int>"), Q.end_mask(response, end).cast("array<int>"))
    out = df.withColumn("input_ids", F.concat(prompt, response)).withColumn("attention_mask", full)
    head = ragged.fold(lambda m: np.maximum(np.cumsum(m, 1) - 1, 0), mask).cast("array<long>")
    last = F.element_at("_head", -1)
    tail = F.transform(F.sequence(F.lit(1).cast("long"), F.size(response).cast("long")), lambda i: last + i)
    return out.withColumn("_head", head).withColumn("position_ids", F.concat("_head", tail)).drop("_head")


def shifted_logprobs(all_logprobs: Column, length: Column) -> Column:
    """Log-probabilities of a response from those of the whole sequence: each token's stands one place before it."""
    n = F.size(all_logprobs)
    return F.slice(all_logprobs, n - length, length)


def masked_values(values: Column, attention: Column, length: Column) -> Column:
    """A critic's values of a response, 0 where the place before the token is masked."""
    n = F.size(attention)
    return Q.times(values, F.slice(attention, n - length, length))


def preference_rows(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Two rows for each: the chosen response (place 0), then the rejected."""
    return df.select("*", F.posexplode(F.array(F.col(chosen), F.col(rejected))).alias("place", "response")).drop(chosen, rejected)


def preference_pair(prompt: Column, chosen: Column, rejected: Column, length: int, pad: int) -> Column:
    """Padded ids and masks of both sequences, each with its own mask."""
    def one(response: Column) -> Column:
        ids = Q.truncate(F.concat(prompt, response), length)
        return F.struct(Q.pad(ids, length, pad).alias("input_ids"), Q.pad(F.transform(ids, lambda _: F.lit(1).cast("long")), length, 0).alias("attention_mask"))

    return F.array(one(chosen), one(rejected))


def cross_entropy(score: Column, accuracy: Column, beta: float) -> Column:
    """Binary cross-entropy of sigmoid(beta * score) against an accuracy, in a stable form."""
    x = score * beta
    return F.greatest(x, F.lit(0.0)) - x * accuracy + F.log1p(F.exp(-F.abs(x)))


def sided_accuracy(score: Column, accuracy: Column) -> Column:
    """1 where the sign of the score says what the accuracy does."""
    return F.when((score > 0) == (accuracy > 0.5), 1.0).otherwise(0.0)


def largest_return(df: DataFrame, rewards: str) -> float:
    """The largest absolute reverse running sum of token rewards in the table, for normalising them."""
    back = ragged.fold(lambda r: np.abs(ragged.reverse_cumsum(r)), rewards)
    return float(df.agg(F.max(F.array_max(back))).first()[0] or 0.0)


def normalised_rewards(df: DataFrame, rewards: str) -> DataFrame:
    """Token rewards by the largest absolute return and a little (1e-6)."""
    top = largest_return(df, rewards)
    return df.withColumn(rewards, F.transform(rewards, lambda r: r / F.lit(top + 1e-6)))


def use_of_peak(flops: float, epochs: int, peak: float, workers: int) -> float:
    """Share of the promised operations a second that were used."""
    return flops * epochs / peak / workers


def packed(df: DataFrame, group: str, order: str, length: str, block: int = 4096) -> DataFrame:
    """df with `begins` and `ends`: the running sum of lengths before and after each row of its group, null groups alike.
    Null lengths are 0. order: distinct whole numbers in each group."""
    d = df.withColumn("_n", F.coalesce(F.col(length).cast("long"), F.lit(0))).withColumn("_block", F.floor(F.col(order) / block))
    sums = d.groupBy(F.col(group).alias("_group"), F.col("_block").alias("_of")).agg(F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_group", "_of", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_in", F.sum("_n").over(inside))
    d = d.join(sums, F.col(group).eqNullSafe(F.col("_group")) & F.col("_block").eqNullSafe(F.col("_of")))
    ends = F.col("_before") + F.col("_in")
    return d.withColumn("begins", ends - F.col("_n")).withColumn("ends", ends).drop("_n", "_block", "_group", "_of", "_before", "_in")


def on_workers(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], workers: int, order: str, schema: str) -> DataFrame:
    """f on equal consecutive chunks, one a worker, each handed over whole and in order; `chunk_id` is added to the schema.
    Rows that don't divide are an error. A chunk must fit a worker, as it must where the function runs for one."""
    n = df.count()
    if n % workers:
        raise ValueError(f"{n} rows don't divide among {workers} workers")
    size = max(n // workers, 1)
    chunked = df.withColumn("chunk_id", F.expr(f"{order} div {size}").cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf.sort_values(order, ignore_index=True).drop(columns="chunk_id")).assign(chunk_id=pdf["chunk_id"].iloc[0])

    return chunked.groupBy("chunk_id").applyInPandas(run, f"{schema}, chunk_id long")


def to_all(df: DataFrame, workers: int) -> DataFrame:
    """Every row once for each worker, with `rank`."""
    return df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))


class CharTokenizer:
    """A token for each character of an alphabet, after the special ones; unknown characters have a token too."""

    def __init__(self, alphabet: str) -> None:
        self.special = ["<pad>", "<eos>", "<unk>"]
        self.ids = {c: i + len(self.special) for i, c in enumerate(dict.fromkeys(alphabet))}
        self.chars = {i: c for c, i in self.ids.items()}

    def encode(self, text: str) -> list[int]:
        return [self.ids.get(c, 2) for c in text]

    def decode(self, ids: list[int]) -> str:
        return "".join(self.chars.get(i, "") for i in ids)
