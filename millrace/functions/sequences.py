"""Column functions on token sequences: masks, positions, padding, statistics, losses. All run in the JVM.

Unless said otherwise a null array gives null and a null element counts as 0.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import ragged


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _zero() -> Column:
    return F.lit(0.0)


def total(values: Column | str) -> Column:
    """Sum of an array of numbers; 0 for an empty one."""
    return F.aggregate(_c(values), _zero(), lambda a, x: a + F.coalesce(x.cast("double"), _zero()))


def times(a: Column | str, b: Column | str) -> Column:
    """Elementwise product; as long as the longer, null elements as 0."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.coalesce(x.cast("double"), _zero()) * F.coalesce(y.cast("double"), _zero()))


def masked_sum(values: Column | str, mask: Column | str) -> Column:
    return total(times(values, mask))


def masked_mean(values: Column | str, mask: Column | str) -> Column:
    """Sum over the mask by the mask's sum and a little (1e-8)."""
    return masked_sum(values, mask) / (total(mask) + 1e-8)


def masked_var(values: Column | str, mask: Column | str, unbiased: bool = True) -> Column:
    """Masked variance about masked_mean; unbiased: by Bessel's correction. Fewer than two masked values are null.

    One pass with running mean and square sum: an expression inside a lambda is evaluated for every element, so the mean
    must not stand there.
    """
    pairs = F.zip_with(_c(values), _c(mask), lambda v, m: F.struct(F.coalesce(v.cast("double"), _zero()).alias("v"), F.coalesce(m.cast("double"), _zero()).alias("w")))
    start = F.struct(_zero().alias("n"), _zero().alias("mean"), _zero().alias("m2"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + x["w"]
        gap = x["v"] - a["mean"]
        mean = a["mean"] + F.when(n > 0, x["w"] / n * gap).otherwise(0.0)
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + x["w"] * gap * (x["v"] - mean)).alias("m2"))

    def finish(a: Column) -> Column:
        off = a["mean"] * (1 - a["n"] / (a["n"] + 1e-8))  # masked_mean divides by a little more than n
        var = (a["m2"] + a["n"] * off * off) / (a["n"] + 1e-8)
        return F.when(a["n"] > 1, var * a["n"] / (a["n"] - 1) if unbiased else var)

    return F.aggregate(pairs, start, step, finish)


def continued_positions(last: Column, length: int) -> Column:
    """last + 1 ... last + length."""
    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(length).cast("long")), lambda i: last + i)


def end_mask(ids: Column | str, ends: int | list[int]) -> Column:
    """1 up to and with the first end token, 0 behind it; all 1 where none is."""
    ends = [ends] if isinstance(ends, int) else ends
    n = F.size(_c(ids))
    first = F.least(*[F.coalesce(F.nullif(F.array_position(_c(ids), F.lit(e).cast("long")), F.lit(0)), n.cast("long")) for e in ends], n.cast("long")).cast("int")
    return F.concat(F.array_repeat(F.lit(1), first), F.array_repeat(F.lit(0), n - first))


def pad(ids: Column | str, length: int, value: int, left: bool = False) -> Column:
    """To at least `length`; longer arrays stay as they are."""
    c = _c(ids)
    more = F.array_repeat(F.lit(value).cast("long"), F.greatest(F.lit(length) - F.size(c), F.lit(0)))
    return F.concat(more, c) if left else F.concat(c, more)


def truncate(ids: Column | str, length: int, side: str = "right") -> Column:
    """To at most `length`: 'right' drops the end, 'left' the beginning, 'error' fails on a longer array."""
    c = _c(ids)
    if side == "right":
        return F.slice(c, 1, length)
    if side == "left":
        return F.slice(c, F.greatest(F.size(c) - length, F.lit(0)) + 1, length)
    if side == "error":
        return F.when(F.size(c) <= length, c).otherwise(F.raise_error(F.concat(F.lit("a sequence of "), F.size(c).cast("string"), F.lit(f" is longer than {length}"))).cast("array<long>"))
    raise ValueError(side)


def unpad(ids: Column | str, mask: Column | str) -> Column:
    """The ids whose mask is 1."""
    return F.transform(F.filter(F.arrays_zip(_c(ids).alias("i"), _c(mask).alias("m")), lambda p: p["m"] == 1), lambda p: p["i"])


def strip_left(ids: Column | str, pad_id: int) -> Column:
    """From the first id that isn't padding on; an all-padding array is empty."""
    c = _c(ids)
    at = F.array_min(F.transform(F.filter(F.transform(c, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["x"] != pad_id), lambda p: p["i"]))
    return F.when(at.isNull(), F.slice(c, 1, 0)).otherwise(F.slice(c, at + 1, F.size(c)))


def place_at(value: Column, at: Column, length: Column | int) -> Column:
    """An array of zeros with one value; a place below 0 is the last, one beyond the end leaves zeros."""
    n = F.lit(length) if isinstance(length, int) else length
    where = F.when(at < 0, n - 1).otherwise(at)
    parts = F.concat(F.array_repeat(_zero(), F.least(where, n)), F.array(value.cast("double")), F.array_repeat(_zero(), F.greatest(n - where - 1, F.lit(0))))
    return F.slice(parts, 1, n)


def response_mask(attention: Column | str, responses: Column | str) -> Column:
    """The attention mask's part that belongs to the response: its last entries."""
    n = F.size(_c(responses))
    return F.slice(_c(attention), F.greatest(F.size(_c(attention)) - n, F.lit(0)) + 1, n)


def divergence(logp: Column | str, ref: Column | str, kind: str) -> Column:
    """Elementwise estimates of the divergence between two policies' log-probabilities: kl, abs, mse, low_var_kl."""
    def one(a: Column, b: Column) -> Column:
        d = F.coalesce(a.cast("double"), _zero()) - F.coalesce(b.cast("double"), _zero())
        if kind == "kl":
            return d
        if kind == "abs":
            return F.abs(d)
        if kind == "mse":
            return F.lit(0.5) * d * d
        if kind == "low_var_kl":
            return F.greatest(F.least(F.exp(-d) + d - 1, F.lit(10.0)), F.lit(-10.0))
        raise ValueError(f"no estimator {kind}")

    return F.zip_with(_c(logp), _c(ref), one)


def penalised(scores: Column | str, divergence_values: Column, mask: Column | str, beta: float) -> Column:
    """score - beta * divergence * mask, elementwise."""
    return F.zip_with(_c(scores), times(divergence_values, mask), lambda s, k: F.coalesce(s.cast("double"), _zero()) - F.lit(beta) * F.coalesce(k, _zero()))


def policy_terms(logp: Column | str, old: Column | str, advantages: Column | str, clip: float, clip_low: float | None = None, clip_high: float | None = None, dual: float = 3.0) -> Column:
    """For each token a struct of the clipped objective: loss, clipped (0 or 1), clipped_low, kl."""
    low, high = clip if clip_low is None else clip_low, clip if clip_high is None else clip_high
    zipped = F.arrays_zip(_c(logp).alias("a"), _c(old).alias("b"), _c(advantages).alias("v"))

    return F.transform(zipped, lambda p: F.struct(*[c.alias(k) for k, c in _policy_term(p, low, high, dual).items()]))


def _policy_term(p: Column, low: float, high: float, dual: float) -> dict[str, Column]:
    ratio_log = p["a"].cast("double") - p["b"].cast("double")
    ratio, v = F.exp(ratio_log), p["v"].cast("double")
    free, bound = -v * ratio, -v * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low))
    upper = F.greatest(free, bound)
    floor = -v * dual
    return {"loss": F.when(v < 0, F.least(upper, floor)).otherwise(upper), "clipped": (bound > free).cast("double"), "clipped_low": ((upper > floor) & (v < 0)).cast("double"), "kl": -ratio_log}


def policy_sums(logp: Column | str, old: Column | str, advantages: Column | str, mask: Column | str, clip: float, clip_low: float | None = None, clip_high: float | None = None, dual: float = 3.0) -> Column:
    """The sums over the mask of all that policy_terms gives, and the mask's as `n`, in a struct: whole batches at once in
    numpy, for a fold of five sums over an array of structs makes five objects a token in the JVM."""
    low, high = clip if clip_low is None else clip_low, clip if clip_high is None else clip_high

    def run(a, b, v, m):  # noqa: ANN001, ANN202
        ratio_log = a - b
        ratio = np.exp(ratio_log)
        free, bound = -v * ratio, -v * np.clip(ratio, 1 - low, 1 + high)
        upper, floor = np.maximum(free, bound), -v * dual
        return {"loss": np.where(v < 0, np.minimum(upper, floor), upper) * m, "clipped": (bound > free) * m, "clipped_low": ((upper > floor) & (v < 0)) * m, "kl": -ratio_log * m, "n": m}

    return ragged.sums(run, ["loss", "clipped", "clipped_low", "kl", "n"], logp, old, advantages, mask)


def value_terms(values: Column | str, old: Column | str, returns: Column | str, clip: float) -> Column:
    """For each token a struct: loss (half the larger of the free and the clipped square error) and clipped (0 or 1)."""
    def one(p: Column) -> Column:
        v, o, r = p["v"].cast("double"), p["o"].cast("double"), p["r"].cast("double")
        bound = F.greatest(F.least(v, o + clip), o - clip)
        free_loss, bound_loss = (v - r) * (v - r), (bound - r) * (bound - r)
        return F.struct((F.lit(0.5) * F.greatest(free_loss, bound_loss)).alias("loss"), (bound_loss > free_loss).cast("double").alias("clipped"))

    return F.transform(F.arrays_zip(_c(values).alias("v"), _c(old).alias("o"), _c(returns).alias("r")), one)


def log_softmax_at(logits: Column | str, index: Column) -> Column:
    """Log-probability of one index (from 0), by shifting with the largest logit."""
    c = F.transform(_c(logits), lambda x: x.cast("double"))
    top = F.array_max(c)
    return F.get(c, index) - top - F.log(F.aggregate(c, _zero(), lambda a, x: a + F.exp(x - top)))


def entropy(logits: Column | str) -> Column:
    """Entropy of the softmax."""
    c = F.transform(_c(logits), lambda x: x.cast("double"))
    top = F.array_max(c)
    z = F.aggregate(c, _zero(), lambda a, x: a + F.exp(x - top))
    return F.log(z) + top - F.aggregate(c, _zero(), lambda a, x: a + x * F.exp(x - top)) / z


def scaled(logits: Column | str, temperature: float) -> Column:
    return F.transform(_c(logits), lambda x: x / F.lit(temperature))


def clipped(values: Column | str, low: Column, high: Column) -> Column:
    return F.transform(_c(values), lambda x: F.greatest(F.least(x, high), low))


def sft_mask(attention: Column | str, prompt_length: Column, response_length: Column) -> Column:
    """Loss mask of a prompt and response: 0 over the prompt but its last token, and 0 on the response's last token."""
    n = F.size(_c(attention))
    head = F.least(prompt_length, n) - 1
    last = F.least(prompt_length + response_length, n) - 1
    return F.transform(_c(attention), lambda m, i: F.when((prompt_length > 1) & (i < head), 0).when(i == last, 0).otherwise(m))


def turn_mask(lengths: Column | str, wanted: Column | str, size: int | None = None) -> Column:
    """Loss mask over turns: lengths of the turns in tokens, and which of them count; padded or cut to `size` if given."""
    spans = F.zip_with(_c(lengths), _c(wanted), lambda n, w: F.array_repeat(F.when(w, 1).otherwise(0), n))
    flat = F.flatten(spans)
    if size is None:
        return flat
    return F.slice(F.concat(flat, F.array_repeat(F.lit(0), F.greatest(F.lit(size) - F.size(flat), F.lit(0)))), 1, size)


def common_prefix(a: Column, b: Column) -> Column:
    """Characters at the beginning that two strings share."""
    n = F.least(F.length(a), F.length(b))
    first = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(first) - 1, n))


def arithmetic_sequence(n1: Column, n2: Column, count: Column | int, modulus: Column | int) -> Column:
    """The numbers that follow n1, n2 in their arithmetic sequence, modulo a bound."""
    n, m = F.lit(count) if isinstance(count, int) else count, F.lit(modulus) if isinstance(modulus, int) else modulus
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.pmod(n2 + k * (n2 - n1), m))


def cumulative_lengths(lengths: Column | str) -> Column:
    """0 and the running sums: where each packed sequence begins and the last ends."""
    c = F.concat(F.array(_zero()), F.transform(_c(lengths), lambda x: x.cast("double")))
    return ragged.fold(lambda v: v.cumsum(1), c).cast("array<long>")


def up_to_multiple(n: Column, multiple: int) -> Column:
    return F.ceil(n / multiple) * multiple


def flops(parameters: float, layers: int, width: int, lengths: Column | str, seconds: Column) -> Column:
    """Teraflops a second of training: 6 * parameters a token and 12 * layers * width times the squared lengths."""
    s = total(lengths)
    squares = F.aggregate(_c(lengths), _zero(), lambda a, x: a + x.cast("double") * x.cast("double"))
    return (6 * parameters * s + 12 * layers * width * squares) / seconds / 1e12


def all_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
