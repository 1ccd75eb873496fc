"""Metrics of evaluations: accuracies, best-of-n by resampling, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

#: Runs of one prompt that are resampled row by row; of more, which would not fit one task, the counts of their values are.
RESAMPLED_RUNS = 2048
#: Picks of prompts with equally many runs that are looked up at once.
_PICKS = 2_000_000


def sizes(n: int) -> list[int]:
    """2, 4, 8 ... below n, and n."""
    return [2**k for k in range(1, 40) if 2**k < n] + [n]


def resampled(n: int, size: int, draws: int = 1000, seed: int = 42) -> np.ndarray:
    """Indices of `draws` samples of n with replacement: numpy's old generator, seeded anew for each call, one draw at a
    time. They depend on no value, so prompts of one size share them."""
    return _kept(n, size, draws, seed) if n <= 256 else _resampled(n, size, draws, seed)


def _resampled(n: int, size: int, draws: int, seed: int) -> np.ndarray:
    rng = np.random.RandomState(seed)
    return np.stack([rng.choice(n, size=size, replace=True).astype(np.uint16 if n <= 1 << 16 else np.int64) for _ in range(draws)])


_kept = lru_cache(maxsize=1024)(_resampled)


def expected_best(values: np.ndarray, size: int) -> float:
    """Exact mean of the largest of `size` values drawn with replacement."""
    v = np.sort(values)
    k = np.arange(1, len(v) + 1) / len(v)
    return float((v * (k**size - (k - 1 / len(v)) ** size)).sum())


def majority_value(values: np.ndarray, votes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """For each draw the value of the first pick of the most frequent vote; of equal ones the one seen first."""
    code = pd.factorize(pd.Series(votes, dtype=object), use_na_sentinel=False)[0][picks]
    counts = np.zeros((len(picks), code.max() + 1), np.int64)
    np.add.at(counts, (np.arange(len(picks))[:, None], code), 1)
    first = np.take_along_axis(counts, code, 1).argmax(1)  # the earliest pick whose vote is the most frequent
    return values[picks[np.arange(len(picks)), first]]


def _row_metrics(v: np.ndarray, codes: np.ndarray | None, draws: int, seed: int) -> list[tuple[str, np.ndarray]]:
    """Metrics of prompts with equally many runs, one a row of v; codes: their votes, numbered in each row."""
    rows, n = v.shape
    out = [(f"mean@{n}", v.mean(1))]
    if n == 1:
        return out
    out.append((f"std@{n}", v.std(1)))
    for size in sizes(n):
        picks = resampled(n, size, draws, seed)
        step = max(1, _PICKS // picks.size)
        made: dict[str, list[np.ndarray]] = {}
        for a in range(0, rows, step):
            drawn = v[a : a + step][:, picks]
            kinds = {"best": drawn.max(2), "worst": drawn.min(2)}
            if codes is not None:
                kinds["maj"] = _majority_values(drawn, codes[a : a + step][:, picks])
            for kind, x in kinds.items():
                made.setdefault(f"{kind}@{size}/mean", []).append(x.mean(1))
                made.setdefault(f"{kind}@{size}/std", []).append(x.std(1))
        out += [(m, np.concatenate(x)) for m, x in made.items()]
    return out


def _majority_values(drawn: np.ndarray, code: np.ndarray) -> np.ndarray:
    """majority_value of draws that are looked up already, over the last axis."""
    kinds = int(code.max()) + 1
    flat = code.reshape(-1, code.shape[-1])
    at = np.arange(len(flat))[:, None]
    counts = np.bincount((at * kinds + flat).ravel(), minlength=len(flat) * kinds).reshape(-1, kinds)
    first = counts[at, flat].argmax(1)
    return drawn.reshape(flat.shape)[at[:, 0], first].reshape(code.shape[:-1])


def _count_metrics(values: np.ndarray, votes: np.ndarray | None, counts: np.ndarray, draws: int, seed: int) -> list[tuple[str, float]]:
    """Metrics of one prompt from the counts of its (value, vote) pairs. Best and worst are exact: mean and deviation of the
    extreme's distribution. The majority is that of `draws` samples of vote counts; equal votes are as likely to be seen
    first, and the first pick of a vote is any of its rows, so the vote's moments stand for its value."""
    n = int(counts.sum())
    order = np.argsort(values, kind="stable")
    v, share = values[order], np.cumsum(counts[order]) / n
    below = np.concatenate(([0.0], share[:-1]))
    mean = float((values * counts).sum() / n)
    out = [(f"mean@{n}", mean), (f"std@{n}", float(np.sqrt((counts * (values - mean) ** 2).sum() / n)))]
    if votes is not None:
        code = pd.factorize(pd.Series(votes, dtype=object), use_na_sentinel=False)[0]
        voters = np.bincount(code, counts)
        moments = np.stack([np.bincount(code, counts * values) / voters, np.bincount(code, counts * values**2) / voters])
        chance = voters / n
    for size in sizes(n):
        for kind, p in (("best", share**size - below**size), ("worst", (1 - below) ** size - (1 - share) ** size)):
            m = float((v * p).sum())
            out += [(f"{kind}@{size}/mean", m), (f"{kind}@{size}/std", float(np.sqrt((p * (v - m) ** 2).sum())))]
        if votes is not None:
            rng, step, got = np.random.RandomState(seed), max(1, _PICKS // len(chance)), []
            for a in range(0, draws, step):
                drawn = rng.multinomial(size, chance, min(step, draws - a))
                got.append(moments[:, (drawn + rng.random_sample(drawn.shape)).argmax(1)])
            m, square = np.concatenate(got, 1).mean(1)
            out += [(f"maj@{size}/mean", float(m)), (f"maj@{size}/std", float(np.sqrt(max(square - m * m, 0.0))))]
    return out


def best_of(df: DataFrame, source: str, prompt: str, variable: str, value: str, order: str, vote: str | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """source, prompt, variable, metric, value: mean@N, std@N (population) and, by resampling, mean and deviation of
    best@n, worst@n and, with votes, maj@n. Null values are left out; a prompt without values has no row. All runs count:
    prompts of more than RESAMPLED_RUNS go by the counts of their values."""
    keys, limit = [source, prompt, variable], RESAMPLED_RUNS

    def metrics(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        """Of the prompts that start at the places."""
        v, n = pdf["_value"].to_numpy(float), np.diff(np.append(first, len(pdf)))
        names = pdf[keys].iloc[first].reset_index(drop=True)
        parts = []
        for k in np.unique(n):
            who = np.flatnonzero(n == k)
            rows = first[who][:, None] + np.arange(k)
            codes = np.stack([pd.factorize(x, use_na_sentinel=False)[0] for x in pdf["_vote"].to_numpy(object)[rows]]) if vote else None
            parts += [names.iloc[who].assign(metric=m, value=x) for m, x in _row_metrics(v[rows], codes, draws, seed)]
        return pd.concat(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            changed = np.zeros(len(pdf), bool)
            for c in keys:
                a, b = pdf[c], pdf[c].shift()
                changed |= ((a != b) & ~(a.isna() & b.isna())).to_numpy(bool)
            changed[0] = True
            first = np.flatnonzero(changed)
            if len(first) > 1:  # the last prompt may go on in the next batch
                yield metrics(pdf.iloc[: first[-1]], first[:-1])
            rest = pdf.iloc[first[-1] :].reset_index(drop=True)
        if rest is not None:
            yield metrics(rest, np.zeros(1, np.int64))

    def run_counts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_value", *(["_vote"] if vote else [])], kind="stable")
        out = _count_metrics(pdf["_value"].to_numpy(float), pdf["_vote"].to_numpy(object) if vote else None, pdf["_n"].to_numpy(np.int64), draws, seed)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, "metric": [m for m, _ in out], "value": [x for _, x in out]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    chosen = df.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias("_value"), *([F.col(vote).alias("_vote")] if vote else []))
    chosen = written(chosen, "runs")
    schema = f"{source} {kinds[source]}, {prompt} {kinds[prompt]}, {variable} {kinds[variable]}, metric string, value double"
    counts = chosen.groupBy(*keys, "_value", *(["_vote"] if vote else [])).agg(F.count("*").alias("_n"))
    large = counts.groupBy(*keys).agg(F.sum("_n").alias("_all")).where(F.col("_all") > limit).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keys)])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys)])
    by_row = chosen.join(large, same, "left_anti").repartition(*keys).sortWithinPartitions(*keys, order, "_value").mapInPandas(run, schema)
    by_count = counts.join(large, same, "left_semi").groupBy(*keys).applyInPandas(run_counts, schema)
    return by_row.unionByName(by_count)


def expected_extremes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, size, best, worst: exact means of the largest and least of `size` values drawn with replacement, for the sizes
    2, 4, 8 ... and all, of each group of two values or more. Null values are left out.

    Rows become counts of values, which are combined before their shuffle; what is ordered are a group's distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shares = counts.select(*keys, "_v", "_n", upto.alias("_upto"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all")).where("_all > 1")
    below = F.filter(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.pow(F.lit(2.0), k).cast("long")), lambda x: x < F.col("_all"))
    each = shares.withColumn("size", F.explode(F.concat(below, F.array("_all"))))
    p, q = F.col("_upto") / F.col("_all"), (F.col("_upto") - F.col("_n")) / F.col("_all")
    best = F.sum(F.col("_v") * (F.pow(p, "size") - F.pow(q, "size")))
    worst = F.sum(F.col("_v") * (F.pow(1 - q, "size") - F.pow(1 - p, "size")))
    return each.groupBy(*keys, "size").agg(best.alias("best"), worst.alias("worst"))


def by_source(metrics: DataFrame, source: str, variable: str) -> DataFrame:
    """Mean over prompts of each metric."""
    return metrics.groupBy(source, variable, "metric").agg(F.avg("value").alias("value"))


def section(variable: Column, metric: Column, core: Column, largest: Column) -> Column:
    """'val-core' for the core variable's mean, std, maj and best at the largest n with a part behind it, else 'val-aux'.
    mean@N and std@N have no such part, so they are auxiliary."""
    name = metric.rlike("^(mean|std|maj|best)")
    at = F.contains(metric, F.concat(F.lit("@"), largest.cast("string"), F.lit("/")))
    return F.when((variable == core) & name & at, "val-core").otherwise("val-aux")


def accuracy(df: DataFrame, category: str, correct: str) -> DataFrame:
    """category, n, right, accuracy, and a row with a null category for all: micro average, `macro` (mean over
    categories). Null correctness counts as wrong."""
    hits = F.sum(F.when(F.col(correct), 1).otherwise(0))
    rows = df.groupBy(category).agg(F.count("*").alias("n"), hits.alias("right"))
    rows = rows.withColumn("accuracy", F.try_divide("right", "n"))
    total = rows.agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.avg("accuracy").alias("macro"))
    each = rows.select(F.lit(False).alias("is_total"), category, "n", "right", "accuracy", F.lit(None).cast("double").alias("macro"))
    return each.unionByName(total.select(F.lit(True).alias("is_total"), F.lit(None).cast("string").alias(category), "n", "right", F.try_divide("right", "n").alias("accuracy"), "macro"))


def reduced(df: DataFrame, group: list[str], value: str, reducers: dict[str, Callable[[np.ndarray], float]]) -> DataFrame:
    """group and a column for each reducer, a user's function of the group's values as an array. Null values are left out; a
    group without values has none. A group meets in one task, as its array must for such a function."""
    names = list(reducers)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["_v"].to_numpy(float)
        return pd.DataFrame([[*key, *(float(reducers[k](values)) for k in names)]], columns=[*group, *names])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    chosen = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    return chosen.groupBy(*group).applyInPandas(run, ", ".join([*(f"{g} {kinds[g]}" for g in group), *(f"{n} double" for n in names)]))


def mean_of_means(df: DataFrame, source: str, row: str, score: str) -> DataFrame:
    """source, test_score: mean over rows of each row's mean over its responses."""
    rows = df.groupBy(source, row).agg(F.avg(score).alias("_s"))
    return rows.groupBy(source).agg(F.avg("_s").alias("test_score"))


STATISTICS = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}


def aggregated(df: DataFrame, group: list[str], metrics: str, statistics: tuple[str, ...] = ("mean", "std")) -> DataFrame:
    """group, name, value for each metric of a map: the mean under the metric's name, others as name:statistic. An unknown
    statistic is an error."""
    unknown = set(statistics) - set(STATISTICS)
    if unknown:
        raise ValueError(f"no statistics {sorted(unknown)}")
    flat = df.select(*group, F.explode(metrics).alias("_k", "_v"))
    made = flat.groupBy(*group, "_k").agg(*[STATISTICS[s]("_v").alias(s) for s in statistics])
    pairs = F.array(*[F.struct((F.col("_k") if s == "mean" else F.concat("_k", F.lit(f":{s}"))).alias("name"), F.col(s).alias("value")) for s in statistics])
    return made.select(*group, F.explode(pairs).alias("_p")).select(*group, "_p.*")


def evaluate(df: DataFrame, group: str, response: str, truth: str, extract: Callable[[Column], Column], equal: Callable[[Column, Column], Column]) -> DataFrame:
    """One example a row in, one row a group out: n, score (mean correctness), chars (mean length of the response). The
    extractor and the comparison make the benchmark; a null answer is wrong."""
    c = F.col
    rows = df.select(c(group), F.coalesce(equal(extract(c(response)), c(truth)).cast("double"), F.lit(0.0)).alias("score"), F.length(response).alias("chars"))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("chars").alias("chars"))
