"""Folds over array columns that run backwards or carry state: whole Arrow batches at a time in numpy.

Spark's higher-order functions copy the array at every step of such a fold, which is quadratic in its length; here the
arrays of a batch become one padded matrix and a step works on all rows. Null arrays give null; arrays of one row that
differ in length are read as if the shorter had zeros (masks: 0) at its end; null elements count as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows x longest, lengths) of a list array; null lists have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.list_flatten(column), 0).to_numpy(zero_copy_only=False).astype(float)
    width = max(width or 0, int(lengths.max()) if len(lengths) else 0)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


def lists(values: np.ndarray, lengths: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A list array from the first `lengths` values of each row; rows that aren't valid are null."""
    flat = values[np.arange(values.shape[1]) < lengths[:, None]]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    mask = None if valid is None else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)


#: Values of one padded matrix at most, but for a single row: rows are taken in order of length until it is full.
CELLS = 4_000_000


def _parts(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in order of length, in parts whose padded matrix has at most CELLS values; a long row pads no others."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        size = lengths[order[at:]]
        full = size * np.arange(1, len(size) + 1) > CELLS
        n = max(1, int(np.argmax(full)) if full.any() else len(size))
        yield np.sort(order[at : at + n])
        at += n


def _aligned(arrays: tuple[pa.Array, ...]) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    valid = np.ones(len(arrays[0]), bool)
    for a in arrays:
        valid &= pc.is_valid(a).to_numpy(zero_copy_only=False)
    return arrays, valid, pc.fill_null(pc.list_value_length(arrays[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def fold(f: Callable[..., np.ndarray], *columns: Column | str) -> Column:
    """f over the padded matrices of array columns; the result is as long as the first array, null where any is null."""

    @F.arrow_udf("array<double>")
    def run(*arrays: pa.Array) -> pa.Array:
        arrays, valid, lengths = _aligned(arrays)
        made, places = [], []
        for rows in _parts(lengths):
            take = pa.array(rows)
            first, n = matrix(arrays[0].take(take))
            others = [matrix(a.take(take), first.shape[1])[0][:, : first.shape[1]] for a in arrays[1:]]
            made.append(lists(f(first, *others), np.where(valid[rows], n, 0), valid[rows]))
            places.append(rows)
        if len(made) <= 1:
            return made[0] if made else pa.array([], pa.list_(pa.float64()))
        return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(places), kind="stable")))

    return run(*columns)


def sums(f: Callable[..., dict[str, np.ndarray]], names: list[str], *columns: Column | str) -> Column:
    """A struct of the row sums of the matrices that f gives by name; null where any array is null."""

    @F.arrow_udf("struct<" + ",".join(f"{k}:double" for k in names) + ">")
    def run(*arrays: pa.Array) -> pa.Array:
        arrays, valid, lengths = _aligned(arrays)
        out = np.zeros((len(names), len(valid)))
        for rows in _parts(lengths):
            take = pa.array(rows)
            first, _ = matrix(arrays[0].take(take))
            others = [matrix(a.take(take), first.shape[1])[0][:, : first.shape[1]] for a in arrays[1:]]
            made = f(first, *others)
            for i, k in enumerate(names):
                out[i, rows] = np.asarray(made[k], float).sum(1)
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names, mask=pa.array(~valid))

    return run(*columns)


def reverse_cumsum(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values[:, ::-1], 1)[:, ::-1]


def discounted(values: np.ndarray, gamma: float, mask: np.ndarray | None = None) -> np.ndarray:
    """R_t = r_t + gamma * R_{t+1}; with a mask the carried return is kept only where it is 1."""
    out = np.zeros_like(values)
    carried = np.zeros(len(values))
    for t in range(values.shape[1] - 1, -1, -1):
        out[:, t] = carried = values[:, t] + gamma * carried
        if mask is not None:
            carried = carried * mask[:, t]
    return out


def general_advantage(rewards: np.ndarray, values: np.ndarray, gamma: float, lam: float) -> np.ndarray:
    """A_t = d_t + gamma * lam * A_{t+1} with d_t = r_t + gamma * V_{t+1} - V_t; nothing follows the last step."""
    following = np.concatenate([values[:, 1:], np.zeros((len(values), 1))], 1)
    return discounted(rewards + gamma * following - values, gamma * lam)
