"""Reading the tables of model output: visible texts of rollouts and judged pairs of evaluation chats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A vocabulary larger than this is no longer sent with the tasks; rollouts are then decoded by a join.
MAX_VOCAB_ROWS = 400_000


def vocabulary(vocab: DataFrame) -> list[str]:
    """Pieces by token id, '' for special tokens and gaps. Its size is checked before it comes to the driver."""
    rows = vocab.select("token_id", F.when(F.col("is_special"), F.lit("")).otherwise(F.col("piece")).alias("piece")).where("token_id >= 0")
    top, n = rows.agg(F.max("token_id"), F.count("*")).first()
    if n == 0:
        return [""]
    if n > MAX_VOCAB_ROWS or top > 4 * MAX_VOCAB_ROWS:
        raise ValueError(f"a vocabulary of {n} rows up to id {top} is beyond MAX_VOCAB_ROWS")
    pieces = [""] * (top + 1)
    for token, piece in rows.collect():
        pieces[token] = piece or ""
    return pieces


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values
    if values.null_count:
        values = pc.fill_null(values, 0)
    return values.to_numpy(zero_copy_only=False), offsets.astype(np.int64)


def decode(ids: pa.Array, mask: pa.Array, pieces: pa.Array, tail: bool) -> pa.Array:
    """Texts of a batch of id lists whose mask is 1. tail: the mask's last entries belong to the ids, else its first.

    Null ids give null; null or short masks hide the ids they don't cover; ids outside the vocabulary add nothing.
    """
    flat, at = _flat(ids)
    bits, mat = _flat(mask)
    length, mlength = np.diff(at), np.diff(mat)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(at[0], at[-1]) - at[:-1][row]
    where = place + (mlength - length)[row] if tail else place
    inside = (where >= 0) & (where < mlength[row])
    where = np.clip(where + mat[:-1][row], 0, max(len(bits) - 1, 0))
    tokens = flat[at[0] : at[-1]]
    seen = inside & (bits[where] == 1 if len(bits) else False) & (tokens >= 0) & (tokens < len(pieces))
    counts = np.concatenate(([0], np.cumsum(np.bincount(row[seen], minlength=len(length))))).astype(np.int32)
    taken = pieces.take(pa.array(tokens[seen]))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(counts), taken), "")
    if ids.null_count:
        text = pc.if_else(ids.is_valid(), text, None)
    return text


def opened(b: pa.RecordBatch, known: pa.Array, prompts: bool) -> dict[str, pa.Array]:
    """row_idx, data_source, n, response and, if wanted, prompt of one batch of rollouts."""
    ids, mask = b.column("responses"), b.column("attention_mask")
    flat, at = _flat(mask)
    lengths = np.diff(ids.offsets.to_numpy())
    total = np.concatenate(([0], np.cumsum(flat == 1)))
    n = total[at[1:]] - total[np.maximum(at[1:] - lengths, at[:-1])]
    out = {"row_idx": b.column("row_idx"), "data_source": b.column("data_source"), "n": pa.array(n, pa.int32()), "response": decode(ids, mask, known, True)}
    if prompts:
        out["prompt"] = decode(b.column("prompts"), mask, known, False)
    return out


def token_columns(prompts: bool) -> list[str]:
    return ["row_idx", "data_source", "responses", "attention_mask"] + ["prompts"] * prompts


def visible_texts(rollout: DataFrame, vocab: DataFrame, prompts: bool = False) -> DataFrame:
    """row_idx, data_source, n (visible tokens), response and, if wanted, prompt: decoded without special tokens.

    Repeated rows are kept as they are; a row without responses has a null text.
    """
    pieces = vocabulary(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(pieces, pa.string())
        for b in batches:
            yield pa.RecordBatch.from_pydict(opened(b, known, prompts))

    schema = "row_idx long, data_source string, n int, response string" + ", prompt string" * prompts
    return rollout.select(*token_columns(prompts)).mapInArrow(run, schema)


def judged_pairs(evals: DataFrame) -> DataFrame:
    """result_id, prompt, response: the last user message and the first assistant message after it.

    A chat without a user message has a null prompt, one without an answer a null response.
    """
    users = F.filter(F.transform("convo", lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())
    last = F.when(F.size(users) > 0, F.element_at(users, -1))
    after = F.filter(F.slice("convo", last + 2, F.greatest(F.size("convo"), F.lit(1))), lambda m: m["role"] == "assistant")
    return evals.select(
        "result_id",
        F.when(last.isNotNull(), F.get("convo", last)["content"]).alias("prompt"),
        F.when(last.isNotNull() & (F.size(after) > 0), F.get(after, 0)["content"]).alias("response"),
    )


def answers(spark: SparkSession, sf_dir: str, prompts: bool = False) -> DataFrame:
    """src, record_id, data_source, n, response and, if wanted, prompt of every rollout and every judged pair."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    more = ["prompt"] * prompts
    a = visible_texts(read("rollout"), read("vocab"), prompts)
    b = judged_pairs(read("eval_results"))
    return a.select(F.lit("rollout").alias("src"), F.col("row_idx").alias("record_id"), "data_source", "n", "response", *more).unionByName(
        b.select(F.lit("eval_results").alias("src"), F.col("result_id").alias("record_id"), F.lit(None).cast("string").alias("data_source"), F.lit(None).cast("int").alias("n"), "response", *more)
    )
