"""Scoring responses: rules by source, rewards from judges' texts, user functions."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import answers as A

Rule = Callable[[Column, Column], Column]


def number_match(response: Column, truth: Column, method: str = "strict", format_score: float = 0.0) -> Column:
    """1 for the right number, format_score for another, 0 for none."""
    given = A.hash_answer(response) if method == "strict" else A.last_number(response)
    return F.when(given.isNull(), 0.0).when(given == truth, 1.0).otherwise(format_score)


def box_match(response: Column, truth: Column) -> Column:
    """1 if the last box equals the truth in one spelling."""
    return F.coalesce(A.equivalent_column(A.box_column(response), truth).cast("double"), F.lit(0.0))


def stated_match(response: Column, truth: Column) -> Column:
    """1 or -1: the stated answer within the last 300 characters, normalised."""
    given = A.minerva(A.stated_answer(F.right(response, F.lit(300))))
    return F.when(given == A.minerva(truth), 1.0).otherwise(-1.0)


def strict_box_match(response: Column, truth: Column) -> Column:
    """1 or -1: the box within the last 100 characters, as it is written."""
    return F.when(A.box_column(F.right(response, F.lit(100))) == truth, 1.0).otherwise(-1.0)


def letter_match(response: Column, truth: Column) -> Column:
    return F.when(A.choice_letter(response) == truth, 1.0).otherwise(0.0)


def box_with_format(response: Column, truth: Column) -> Column:
    """0.9 for a right box and 0.1 for thoughts in <think> before it."""
    shaped = response.rlike("(?s)^<think>.*</think>.*\\\\boxed\\{.*\\}.*$").cast("double")
    return F.coalesce(A.math_equal_column(A.box_column(response), truth).cast("double"), F.lit(0.0)) * 0.9 + F.coalesce(shaped, F.lit(0.0)) * 0.1


def tests_match(passed: Column, continuous: bool, most: int = 10) -> Column:
    """From an array of test results: 1 if all passed, else 0 or, continuous, the share of the first `most`."""
    every = F.forall(passed, lambda x: x)
    part = F.slice(passed, 1, most)
    share = F.try_divide(F.size(F.filter(part, lambda x: x)).cast("double"), F.size(part))
    return F.when(every, 1.0).otherwise(F.coalesce(share, F.lit(0.0)) if continuous else F.lit(0.0))


def dispatch(source: Column, response: Column, truth: Column, rules: dict[str, Rule], default: Rule | None = None) -> Column:
    """The rule of each row's source; a source without a rule is an error unless a default is given."""
    if default is None:
        other = F.raise_error(F.concat(F.lit("no rule for source "), F.coalesce(source, F.lit("null")))).cast("double")
    else:
        other = default(response, truth)
    return reduce(lambda out, item: F.when(source == item[0], item[1](response, truth)).otherwise(out), reversed(list(rules.items())), other)


def judged_reward(solution: Column, judge: Column, given_tokens: Column, truth_tokens: Column) -> Column:
    """-0.5 without a solution; 1 less 0.05 for each token of difference, ten at most, where the judge says yes; else 0."""
    says_yes = F.contains(judge, F.lit("Final Decision: Yes"))
    return F.when(solution.isNull(), -0.5).when(says_yes, 1.0 - 0.05 * F.least(F.abs(given_tokens - truth_tokens), F.lit(10))).otherwise(0.0)


class Registry:
    """User functions by name: on values, or on whole batches of lists."""

    def __init__(self) -> None:
        self.rows: dict[str, Callable] = {}
        self.batches: dict[str, Callable] = {}

    def row(self, name: str, f: Callable) -> None:
        self.rows[name] = f

    def batch(self, name: str, f: Callable) -> None:
        self.batches[name] = f

    def from_file(self, path: str, function: str, **fixed: object) -> None:
        """Registers a function of a file of the user's, with fixed arguments. The file is the user's own and trusted."""
        spec = importlib.util.spec_from_file_location("millrace_user_rule", path)
        if spec is None or spec.loader is None:
            raise FileNotFoundError(path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        f = getattr(module, function)
        self.row(function, lambda *a: f(*a, **fixed))

    def column(self, name: str, *cols: Column | str, failed: float = 0.0) -> Column:
        """The function as a column of doubles; a row that fails scores `failed`."""
        if name in self.batches:
            batch = self.batches[name]

            @F.arrow_udf("double")
            def run(*arrays: pa.Array) -> pa.Array:
                return pa.array([float(x) for x in batch(*(a.to_pylist() for a in arrays))], pa.float64())

            return run(*cols)
        f = self.rows[name]

        def one(row: tuple) -> float:
            try:
                out = f(*row)
                return float(out["score"] if isinstance(out, dict) else out[0] if isinstance(out, tuple) else out)
            except Exception:  # noqa: BLE001  a user's function may raise anything
                return failed

        @F.arrow_udf("double")
        def each(*arrays: pa.Array) -> pa.Array:
            return pa.array([one(r) for r in zip(*(a.to_pylist() for a in arrays))], pa.float64())

        return each(*cols)


def shown_examples(df: DataFrame, source: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each source: ranks within salted parts first, so no source meets in one task."""
    from pyspark.sql import Window

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(64)))
    part = salted.withColumn("_k", F.row_number().over(Window.partitionBy(source, "_salt").orderBy(order))).where(F.col("_k") <= most)
    return part.withColumn("_k", F.row_number().over(Window.partitionBy(source).orderBy(order))).where(F.col("_k") <= most).drop("_k", "_salt")
