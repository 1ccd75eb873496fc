"""Problem 1: the share of a record's text that repeats earlier text of the same record.

Method: document statistics (shares of words inside runs seen earlier, at five run lengths; repeated sentences; the
longest repeat; vocabulary figures) go through gradient-boosted trees with monotonic constraints, trained on composed
texts whose repeated share is known. One pass over the rows, no shuffle but for repeated ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import boost, records
from millrace.llm import wordgrid as W

RUNS = (3, 5, 8, 13, 20)
#: Characters of a run of symbols.
SYMBOLS = 16
#: A word of so many characters is looked into for loops.
LONG_WORD = 40
FEATURES = [*(f"share_{k}" for k in RUNS), "sentences", "longest", "symbols", "vocabulary", "top_word", "wide", "log_words"]
#: More repeated content never lowers the prediction; the other figures may act either way.
MONOTONE = np.array([1] * len(RUNS) + [1, 1, 1, 0, 0, 0, 0])
#: Composed training records; the bound on what the model is fitted on.
TRAINING_RECORDS = 4000
HELD_OUT = 1200
THRESHOLD = 0.4
#: Records worked on at once in a worker.
CHUNK = 2000


def _equal(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal an earlier entry, and which equal any other."""
    again, shared = np.zeros((2, len(key)), bool)
    if not len(key):
        return again, shared
    order = np.argsort(key)  # equal entries in any order: the earliest is looked for among them
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    later = np.concatenate(([False], same))
    either = later.copy()
    either[:-1] |= same
    some, later = order[either], later[either]
    if len(some):
        shared[some] = again[some] = True
        again[np.minimum.reduceat(some, np.flatnonzero(~later))] = False
    return again, shared


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier entry."""
    return _equal(key)[0]


def _share(flag: np.ndarray, weight: np.ndarray, g: W.Grid) -> np.ndarray:
    return W.per_doc(g, np.where(flag, weight, 0).astype(float)) / np.maximum(W.per_doc(g, weight.astype(float)), 1)


def statistics(texts: list[str]) -> np.ndarray:
    """The features of each text. A null, empty or wordless text has zeros, but for loops of symbols."""
    g = W.grid(texts, digits="mask")
    n = len(g.hash)
    weight = (g.end - g.start).astype(float)
    with np.errstate(over="ignore"):
        salt = W.mix(g.doc.astype(np.uint64) + np.uint64(0xA5)) if n else g.hash
        columns = []
        alike, size = np.ones(n, bool), 1  # words at which a run of `size` words begins that stands elsewhere too
        for k in RUNS:
            # a run of k words stands elsewhere only if the shorter runs that it begins and ends with do
            m = max(n - k + 1, 0)
            at = np.flatnonzero(alike[:m] & alike[k - size : k - size + m] & (g.doc[:m] == g.doc[n - m :]))
            h = W.runs(g, at, k)
            again, shared = _equal(h ^ salt[at])
            alike, size = np.zeros(n, bool), k
            alike[at[shared]] = True
            flag = W.covered(n, at[again], k) if n else np.zeros(0, bool)
            columns.append(_share(flag, weight, g))
            if k == 8:
                runs = flag
        # sentences: runs of words between end marks
        if n:
            stop = np.isin(g.points, np.array([ord(c) for c in ".!?。！？\n"], np.uint32))
            ends = np.concatenate(([0], np.cumsum(stop)))
            # a mark inside a number, as in 3.5, ends no sentence that matters here: both parts stay in order
            part = ends[g.start] + g.doc
            new = np.concatenate(([True], (part[1:] != part[:-1]) | (g.doc[1:] != g.doc[:-1])))
            head = np.flatnonzero(new)
            sentence = np.cumsum(new) - 1
            numbering = (g.hash == 1) & new  # a leading number
            up, down = W.powers(n + 1)
            value = np.where(numbering, np.uint64(0), g.hash)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up[:-1])))
            tail = np.concatenate((head[1:], [n]))
            lead = head + numbering[head]
            lead = np.minimum(lead, tail - 1)
            key = W.mix((total[tail] - total[lead]) * down[lead]) ^ salt[head]
            again = _repeated(key) & (tail - head >= np.where(g.wide[head], 6, 3))
            columns.append(_share(again[sentence], weight, g))
            # longest run of words covered at eight words
            edge = np.concatenate(([True], (runs[1:] != runs[:-1]) | (g.doc[1:] != g.doc[:-1])))
            run_id = np.cumsum(edge) - 1
            size = np.bincount(run_id, np.where(runs, weight, 0))
            longest = np.zeros(len(texts))
            np.maximum.at(longest, g.doc[np.flatnonzero(edge)], size)
            columns.append(longest / np.maximum(W.per_doc(g, weight), 1))
        else:
            columns += [np.zeros(len(texts))] * 2
    columns.append(_symbol_loops(texts, g))
    count = g.counts()
    if n:
        key = g.hash ^ salt
        again = _repeated(key)
        distinct = W.per_doc(g, (~again).astype(float))
        order = np.argsort(key, kind="stable")
        edge = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        sizes = np.diff(np.concatenate((np.flatnonzero(edge), [n])))
        top = np.zeros(len(texts))
        np.maximum.at(top, g.doc[order][edge], sizes)
    else:
        distinct = top = np.zeros(len(texts))
    safe = np.maximum(count, 1)
    columns += [distinct / safe, top / safe, W.per_doc(g, g.wide.astype(float)) / safe if n else np.zeros(len(texts)), np.log1p(count)]
    return np.stack(columns, 1)


def _symbol_loops(texts: list[str], g: W.Grid) -> np.ndarray:
    """Share of the characters, spaces left out, that lie in runs of SYMBOLS characters seen earlier: anywhere in texts that
    are less than half words, for in others the words decide, and there only within words of LONG_WORD characters or more,
    as a loop of a syllable or a figure makes them."""
    out = np.zeros(len(texts))
    inner = g.end - g.start
    words = W.per_doc(g, inner.astype(float)) if len(g.hash) else np.zeros(len(texts))
    symbolic = words < 0.5 * np.array([len(t or "") for t in texts])
    long = np.flatnonzero((inner >= LONG_WORD) & ~symbolic[g.doc])
    pieces: list[tuple[int, str]] = [(i, "".join((texts[i] or "").split())) for i in np.flatnonzero(symbolic).tolist()]
    for k in long.tolist():
        i = int(g.doc[k])
        at = int(g.begins[i])
        pieces.append((i, texts[i][int(g.start[k]) - at : int(g.end[k]) - at].lower()))
    pieces = [(i, t) for i, t in pieces if len(t) >= SYMBOLS + 4]
    if not pieces:
        return out
    owner = np.array([i for i, _ in pieces])
    points, begins = W.join_points([t for _, t in pieces])
    piece = np.searchsorted(begins, np.arange(len(points)), "right") - 1
    n = len(points) - SYMBOLS + 1
    at = np.flatnonzero(piece[:n] == piece[SYMBOLS - 1 :])
    at = at[at + SYMBOLS < begins[piece[at] + 1]]  # not over the line feed that ends a piece
    up, down = W.powers(len(points) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        key = W.mix((total[at + SYMBOLS] - total[at]) * down[at]) ^ W.mix(owner[piece[at]].astype(np.uint64))
    flag = W.covered(len(points), at[_repeated(key)], SYMBOLS)
    flagged = np.bincount(owner, np.add.reduceat(flag, begins[:-1]), minlength=len(texts))
    for i in np.unique(owner).tolist():
        out[i] = flagged[i] / max(sum(not c.isspace() for c in texts[i]), 1)
    return out


def _compose(rng: np.random.Generator, kind: str) -> tuple[str, float]:
    """One text and the share of its characters that repeats earlier text of it."""
    wide = kind == "wide"
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 900)] if wide else None
    word = (lambda: letters[rng.integers(900)]) if wide else (lambda: "".join(chr(97 + rng.integers(26)) for _ in range(rng.integers(2, 9))))
    glue = "" if wide else " "
    phrases = [glue.join(word() for _ in range(rng.integers(*((5, 9) if wide else (2, 6))))) for _ in range(rng.integers(3, 9))]

    def sentence() -> str:
        parts = [word() for _ in range(rng.integers(*((9, 18) if wide else (4, 12))))]
        for _ in range(rng.integers(0, 3)):  # patterns that different sentences share
            parts.insert(rng.integers(len(parts) + 1), phrases[rng.integers(len(phrases))])
        return glue.join(parts)

    def changed(s: str) -> str:
        how = rng.integers(7)
        if how == 1:
            return s.upper()
        if how == 2:
            return s.replace(" ", "  ")
        if how == 3:
            return f"{rng.integers(1, 40)}. {s}"
        if how == 4:
            return f"{word()} {rng.integers(1, 40)}: {s}"
        if how == 5 and len(s) > 12:
            return s[: rng.integers(len(s) // 2, len(s))]
        return s

    end = "。" if wide else ". "
    size = int(rng.integers(1, 12))
    own = [sentence() for _ in range(size)]
    parts: list[tuple[str, bool]] = [(s, False) for s in own]
    want = rng.random()
    if rng.random() < 0.25:
        want = 0.0
    elif rng.random() < 0.3:
        want = 0.25 + 0.3 * rng.random()
    total = sum(map(len, own))
    copied = 0
    if rng.random() < 0.2 and want > 0:
        unit = glue.join(word() for _ in range(rng.integers(1, 6)))
        times = int(want / max(1 - want, 0.02) * total / max(len(unit), 1)) + 2
        loop = [(unit, i > 0) for i in range(min(times, 400))]
        return _join(parts + loop, end, glue)
    hot = own[rng.integers(size)]
    while total and copied / (total + copied) < want and len(parts) < 80:
        source = hot if rng.random() < 0.6 else own[rng.integers(size)]
        first = next(i for i, (s, _) in enumerate(parts) if s is source or s == source)
        at = int(rng.integers(first + 1, len(parts) + 1))
        parts.insert(at, (changed(source), True))
        copied += len(source)
    return _join(parts, end, glue)


def _join(parts: list[tuple[str, bool]], end: str, glue: str) -> tuple[str, float]:
    weigh = lambda s: sum(c.isalnum() for c in s)
    total = sum(weigh(s) for s, _ in parts)
    again = sum(weigh(s) for s, copy in parts if copy)
    return "".join(s + (end if len(s) > 14 or not glue else glue) for s, _ in parts), again / max(total, 1)


@dataclass
class Shares:
    """The trees, and the true shares that stand behind their predictions: a fit by least squares draws every prediction
    towards the mean, so the prediction is read on the curve of mean predictions by true share."""

    forest: boost.Forest
    predicted: np.ndarray
    true: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.forest.score(x), self.predicted, self.true)


@lru_cache(maxsize=1)
def model() -> Shares:
    """The trees, trained on TRAINING_RECORDS composed records, and their curve from HELD_OUT others; the same each time."""
    rng = np.random.default_rng(20240)
    made = [_compose(rng, "wide" if i % 3 == 0 else "spaced") for i in range(TRAINING_RECORDS)]
    made += [("=-~"[i % 3] * 2 * int(rng.integers(12, 90)), 0.95) for i in range(60)]
    for i in range(120):  # a sentence, then a loop of symbols
        text, _ = _compose(rng, "spaced")
        loop = ("=-", "~", "* ", "\\quad ", "- ")[i % 5] * int(rng.integers(30, 120))
        made.append((text[: 20 + i] + " " + loop, len(loop) / (len(loop) + 20 + i)))
    for i in range(160):  # a loop within one word, alone or behind sentences
        text, share = _compose(rng, "wide" if i % 3 == 0 else "spaced")
        text = text[: int(rng.integers(0, 400))] if i % 2 else ""
        loop = ("ha", "3", "0", "ab1", "é")[i % 5] * int(rng.integers(45, 300))
        made.append((f"{text} {loop}", len(loop) / (len(loop) + sum(c.isalnum() for c in text))))
    made += [(" ".join(["so", "we", "get", str(i), "think", "done"][: i % 7]), 0.0) for i in range(350)]  # short and whole
    forest = boost.fit(statistics([t for t, _ in made]), np.array([s for _, s in made]), MONOTONE)
    held = [_compose(rng, "wide" if i % 3 == 0 else "spaced") for i in range(HELD_OUT)]
    guess, true = forest.score(statistics([t for t, _ in held])), np.array([s for _, s in held])
    middle = np.arange(0.1, 0.8, 0.05)  # where composed shares lie close enough to each other
    mean = np.array([guess[np.abs(true - m) < 0.05].mean() for m in middle])
    return Shares(forest, np.concatenate(([0.0], np.maximum.accumulate(mean), [1.0])), np.concatenate(([0.0], middle, [1.0])))


def repeated_share(texts: list[str]) -> np.ndarray:
    """Predicted repeated share of each text, from 0 to 1."""
    if not texts:
        return np.zeros(0)
    return np.clip(model().score(statistics(texts)), 0, 1)


def measure(df: DataFrame, ids: list[str], text: str = "response") -> DataFrame:
    """The id columns with `share`, the repeated share of the text.

    Null, empty and blank texts have share 0. A text of any length is read whole. Repeated rows keep their row.
    Other columns are left out, so names in the table can't clash.
    """
    forest = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, CHUNK) for whole in batches for i in range(0, whole.num_rows, CHUNK)):
            share = np.clip(forest.score(statistics([t or "" for t in b.column("_text").to_pylist()])), 0, 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ids), pa.array(share)], [*ids, "share"])

    chosen = df.select(*ids, F.col(text).alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*ids).schema) + ", share double"
    return chosen.mapInArrow(run, schema)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which at least two fifths repeat earlier text of the same record."""
    shares = measure(records.answers(spark, sf_dir), ["src", "record_id"])
    return shares.where(F.col("share") >= THRESHOLD).select("src", "record_id").distinct()


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated share of every record, each id once, rounded to six places."""
    shares = measure(records.answers(spark, sf_dir), ["src", "record_id"])
    return shares.groupBy("src", "record_id").agg(F.round(F.max("share"), 6).alias("share"))
