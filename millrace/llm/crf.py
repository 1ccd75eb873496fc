"""Linear-chain conditional random field in numpy: batched training and Viterbi decoding over whole batches of lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """emission: one row of label scores per feature value, tables of all features laid one after another."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines in order of falling length, how many lines reach each step, and where each line begins."""
    order = np.argsort(-lengths, kind="stable")
    top = int(lengths.max()) if len(lengths) else 0
    reach = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(top), "right")
    return order, reach, np.concatenate(([0], np.cumsum(lengths)))[:-1]


def scores(model: Chain, features: np.ndarray, part: int = 200_000) -> np.ndarray:
    """Emission scores of each token. features: a row of feature values per token."""
    out = np.empty((len(features), model.emission.shape[1]), np.float32)
    for a in range(0, len(features), part):
        rows = features[a : a + part]
        total = model.emission[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            total += model.emission[rows[:, j]]
        out[a : a + part] = total
    return out


def viterbi(model: Chain, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of all tokens. All lines step together; a step costs as much as there are lines that long."""
    labels = emission.shape[1]
    out = np.zeros(len(emission), np.int8)
    lengths = np.asarray(lengths)
    if not len(emission):
        return out
    order, reach, begins = _layout(lengths)
    begin = begins[order]
    back: list[np.ndarray] = []
    best = model.start + emission[begin[: reach[0]]]
    final = np.zeros((len(order), labels), np.float32)
    final[: len(best)] = best
    for t in range(1, len(reach)):
        n = reach[t]
        step = final[:n, :, None] + model.transition
        came = step.argmax(1).astype(np.int8)
        final[:n] = np.take_along_axis(step, came[:, None, :].astype(np.int64), 1)[:, 0] + emission[begin[:n] + t]
        back.append(came)
    now = final[: reach[0]].argmax(1)
    for t in range(len(reach) - 1, 0, -1):
        n = reach[t]
        at = begin[:n] + t
        out[at] = now[:n]
        now[:n] = back[t - 1][np.arange(n), now[:n]]
    out[begin[: reach[0]]] = now[: reach[0]]
    return out


@dataclass
class _Shard:
    features: np.ndarray
    gold: np.ndarray
    lengths: np.ndarray
    reach: np.ndarray
    begin: np.ndarray
    begins: np.ndarray
    pairs: np.ndarray
    rows: np.ndarray
    edges: np.ndarray
    keys: np.ndarray
    seen: np.ndarray


def _shard(features: np.ndarray, gold: np.ndarray, lengths: np.ndarray, chosen: np.ndarray, labels: int) -> _Shard:
    line = np.repeat(np.arange(len(lengths)), lengths)
    keep = chosen[line]
    features, gold, lengths = features[keep], gold[keep], lengths[chosen]
    order, reach, begins = _layout(lengths)
    first = np.zeros(len(features), bool)
    first[begins] = True
    pairs = np.flatnonzero(~first)
    seen = np.zeros((labels, labels))
    np.add.at(seen, (gold[pairs - 1], gold[pairs]), 1)
    flat = features.reshape(-1)
    by = np.argsort(flat, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], flat[by][1:] != flat[by][:-1])))
    return _Shard(features, gold, lengths, reach, begins[order], begins, pairs, by // features.shape[1], edges, flat[by][edges], seen)


def _gradients(model: Chain, s: _Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean gradient over a shard's lines: (rows of the emission table, their gradients, transition, start).

    Forward and backward go over probabilities that are scaled at each token, so every step is a product of matrices.
    """
    labels = len(model.start)
    e = scores(model, s.features)
    p = np.exp(e - e.max(1, keepdims=True)).astype(float)
    move = np.exp(model.transition - model.transition.max()).astype(float)
    alpha, scale = np.zeros_like(p), np.ones(len(p))

    def place(at: np.ndarray, x: np.ndarray) -> None:
        scale[at] = x.sum(1)
        alpha[at] = x / scale[at, None]

    place(s.begin, np.exp(model.start - model.start.max()) * p[s.begin])
    for t in range(1, len(s.reach)):
        at = s.begin[: s.reach[t]] + t
        place(at, (alpha[at - 1] @ move) * p[at])
    beta = np.ones_like(p)
    for t in range(len(s.reach) - 1, 0, -1):
        at = s.begin[: s.reach[t]] + t
        beta[at - 1] = (p[at] * beta[at] / scale[at, None]) @ move.T
    marginal = alpha * beta
    joint = move * (alpha[s.pairs - 1].T @ (p[s.pairs] * beta[s.pairs] / scale[s.pairs, None]))
    gap = (np.eye(labels)[s.gold] - marginal).astype(np.float32)
    n = len(s.lengths)
    return s.keys, np.add.reduceat(gap[s.rows], s.edges, 0) / n, ((s.seen - joint) / n).astype(np.float32), gap[s.begins].sum(0) / n


def fit(features: np.ndarray, gold: np.ndarray, lengths: np.ndarray, values: int, labels: int, rounds: int = 20, shards: int = 6, rate: float = 0.12, ridge: float = 2e-5) -> Chain:
    """Maximises the conditional likelihood by Adam over shards of the lines; every line has at least one token."""
    model = Chain(np.zeros((values, labels), np.float32), np.zeros((labels, labels), np.float32), np.zeros(labels, np.float32))
    parts = [_shard(features, gold, lengths, np.arange(len(lengths)) % shards == k, labels) for k in range(shards)]
    tables = (model.emission, model.transition, model.start)
    moments = [np.zeros_like(p) for p in tables]
    squares = [np.zeros_like(p) for p in tables]
    step = 0
    for r in range(rounds):
        for part in parts:
            step += 1
            keys, g_emission, g_transition, g_start = _gradients(model, part)
            pace = rate * 0.91**r / (1 - 0.9**step)
            rest = 1 - 0.99**step
            for k, (rows, g) in enumerate(((keys, g_emission), (slice(None), g_transition), (slice(None), g_start))):
                p, m, q = tables[k], moments[k], squares[k]
                g = (g - ridge * p[rows]).astype(np.float32)
                m[rows] += 0.1 * (g - m[rows])
                q[rows] += 0.01 * (g * g - q[rows])
                p[rows] += pace * m[rows] / (np.sqrt(q[rows] / rest) + 1e-8)
    return model
