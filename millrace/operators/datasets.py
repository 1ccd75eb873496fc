"""Rows for reinforcement learning from tables of questions: one builder, a registry of tasks, samplers and collation.

A built row has data_source, prompt (a chat), ability, reward_model (style, ground_truth) and extra_info (split, index,
answer, question). Nulls stay nulls; extra columns are left out, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import text as T
from millrace.operators import frame

Mapper = Callable[[DataFrame], DataFrame]


def built(df: DataFrame, index: str | Column, source: Column, content: Column, truth: Column, ability: str, style: str | Column, split: str, question: Column, answer: Column, system: str | None = None) -> DataFrame:
    """One row for each, with an optional system message before the prompt."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    chat = F.array(*([said("system", F.lit(system))] if system else []), said("user", content))
    at = F.col(index) if isinstance(index, str) else index
    return df.select(
        source.alias("data_source"),
        chat.alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct((F.lit(style) if isinstance(style, str) else style).alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), at.alias("index"), answer.alias("answer"), question.alias("question")).alias("extra_info"),
    )


class Tasks:
    """Mappers by task name. A name is registered once, and the columns a mapper needs are checked before it runs."""

    def __init__(self) -> None:
        self._tasks: dict[str, tuple[tuple[str, ...], Mapper]] = {}

    def add(self, name: str, needs: tuple[str, ...], mapper: Mapper) -> None:
        if name in self._tasks:
            raise ValueError(f"task {name} exists")
        self._tasks[name] = (needs, mapper)

    def names(self) -> list[str]:
        return sorted(self._tasks)

    def build(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self._tasks:
            raise KeyError(f"no task {name}; there are {self.names()}")
        needs, mapper = self._tasks[name]
        missing = [c for c in needs if c not in df.columns]
        if missing:
            raise ValueError(f"task {name} needs columns {missing}")
        return mapper(df)


def hash_numbers(df: DataFrame, instruction: str, split: str) -> DataFrame:
    """Word problems whose answer ends in '#### number': question, answer, index."""
    q = F.col("question")
    return built(df, "index", F.lit("numbers"), T.with_instruction("question", instruction), A.hash_answer("answer"), "math", "rule", split, q, F.col("answer"))


def boxed_solutions(df: DataFrame, instruction: str, split: str) -> DataFrame:
    """Problems whose solution holds the answer in its last box: question, solution, index."""
    truth = A.unboxed_column(A.box_part_column("solution"))
    return built(df, "index", F.lit("boxes"), T.with_instruction("question", instruction), truth, "math", "rule", split, F.col("question"), F.col("solution"))


def endings(df: DataFrame, split: str) -> DataFrame:
    """Texts with endings to choose from: activity, context, endings, label, index. Rows without a label are left out."""
    c = df.where(F.length("label") > 0)
    content = F.concat(T.tidied("activity"), F.lit(": "), T.tidied("context"))
    return built(c, "index", F.lit("endings"), content, F.col("label"), "nlp", "model", split, F.col("context"), F.get("endings", F.col("label").cast("int")))


def with_options(df: DataFrame, instruction: str, split: str) -> DataFrame:
    """Questions with lettered options: question, options, letter, index."""
    content = F.concat(F.col("question"), F.lit("\n"), T.options_block("options"), F.lit(instruction))
    return built(df, "index", F.lit("choice"), content, F.col("letter"), "choice", "rule", split, F.col("question"), F.col("letter"))


def preferred(df: DataFrame, split: str) -> DataFrame:
    """Prompts with a chosen response: prompt, chosen, index."""
    return built(df, "index", F.lit("preference"), F.col("prompt"), F.col("chosen"), "alignment", "model", split, F.col("prompt"), F.col("chosen"))


def shuffled_options(df: DataFrame, key: str, options: str, right: str, seed: int = 0) -> DataFrame:
    """df with `shuffled`, the options in the order of a hash of seed, key and option, and `gold`, the place of the right one
    from 0; null where it is none of them. Equal options stand together."""
    keyed = F.transform(options, lambda o: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), o)).alias("h"), o.alias("o")))
    made = df.withColumn("shuffled", F.transform(F.array_sort(keyed), lambda x: x["o"]))
    return made.withColumn("gold", F.nullif(F.array_position("shuffled", F.col(right)), F.lit(0)) - 1)


def rank_sample(df: DataFrame, ranks: int, rank: int) -> DataFrame:
    """The rows of one rank: every `ranks`-th position from `rank` on, of the batch padded by leading rows until all ranks have
    as many. Padded rows have is_pad true."""
    padded, _ = frame.pad_to_divisor(df, ranks)
    return padded.where(F.col(frame.IDX) % ranks == rank).withColumn(frame.IDX, F.expr(f"{frame.IDX} div {ranks}"))
