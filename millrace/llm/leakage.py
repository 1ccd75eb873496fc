"""Problem 7: passages of held-out test items inside a corpus.

Method: windows of twelve words, of items and of documents, go through the CGK random walk, which embeds edit distance
in Hamming distance; repeated sampling of the embedding's places gives bucket keys, and every window that meets an item's
window in a bucket is verified by exact edit distance over words, and so are the windows around each one verified, which
need no bucket. An item leaks into a document if verified windows cover
at least fourteen successive words of its question or solution. Items are a stated query set: they come to the driver one
block of bounded size at a time, each block is one pass over the documents, and a task holds one block. Documents are
never shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import wordgrid as W

WINDOW, EDITS, PASSAGE = 12, 2, 14
#: Steps of the walk, repetitions, and places sampled in each repetition.
STEPS, REPEATS, SAMPLED = 3 * WINDOW, 16, 5
#: Edits within which an item leaks at a place even if another item is nearer there.
VARIANT = 1
#: A sentence is shared wording and no passage if more than this share of all items hold it, in at least SHARED_TEXTS
#: different questions or solutions. What is rarer stays, in however many items it stands.
SHARED_SHARE, SHARED_TEXTS = 0.3, 5
#: Pairs of windows that are compared at once.
PAIRS = 1_000_000
#: Item windows in one block; a block's keys are about REPEATS * 16 bytes a window.
BLOCK_WINDOWS = 300_000

_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐]\s*\r?\n[>\s#*|]*(?=[^\W\d_])")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
_ESCAPE = re.compile(r"\\[nrt](?![a-z])|\\[nrt](?=[A-Z\"\\])|\\u00a0")
_INVISIBLE = re.compile("[​-‏⁠﻿\xad]")
_NUMBERED = re.compile(r"(?m)^\s*(?:>\s*)+")


def plain(text: str) -> str:
    """The text without markup, with words that a line break cut joined again."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    text = _INVISIBLE.sub("", text)
    if ">" in text:
        text = _NUMBERED.sub("", text)
    return _HYPHEN.sub("", text)


_SEEDS = np.random.default_rng(4242)
_WALKS = _SEEDS.integers(1, 1 << 63, REPEATS, dtype=np.uint64) | np.uint64(1)
#: Places are sampled from the part of the walk that windows as good as surely reach with words left.
_PLACES = [np.sort(_SEEDS.choice(2 * WINDOW - 4, SAMPLED, replace=False)) for _ in range(REPEATS)]


def embed(words: np.ndarray, at: np.ndarray, repeat: int) -> np.ndarray:
    """Bucket key of the windows that start at the places: the sampled places of the walk, hashed.

    At step j the walk writes the word it stands on and moves on if bit j of that word's hash is set.
    """
    with np.errstate(over="ignore"):
        bits = W.mix(words * _WALKS[repeat])
        key = np.full(len(at), repeat + 1, np.uint64)
        place = at.copy()
        end = at + WINDOW
        wanted = set(_PLACES[repeat].tolist())
        padded = np.concatenate((words, np.zeros(1, np.uint64)))
        bits = np.concatenate((bits, np.zeros(1, np.uint64)))
        last = max(wanted)
        for j in range(last + 1):
            here = np.where(place < end, place, len(words))
            if j in wanted:
                key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ padded[here])
            if j < last:
                place += ((bits[here] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return key


def numbers(g: W.Grid) -> np.ndarray:
    """Which words are numbers."""
    digits = np.concatenate(([0], np.cumsum(W.classes(g.points) == W.DIGIT)))
    return digits[g.end] - digits[g.start] == g.end - g.start


def edit_distance(a: np.ndarray, b: np.ndarray, a_number: np.ndarray | None = None, b_number: np.ndarray | None = None, most: int = EDITS) -> np.ndarray:
    """Word edit distance of each pair of windows, exact up to `most`, more beyond; all pairs step together.

    With flags, a number in the place of another number counts as two edits: exchanged words leave an item's figures or
    drop them, while other figures in the same sentence make another item.
    """
    n, size = a.shape
    far = np.int8(most + 1)
    row = {j: np.full(n, min(j, most + 1), np.int8) for j in range(min(most, size) + 1)}
    for i in range(1, size + 1):
        new: dict[int, np.ndarray] = {}
        for j in range(max(0, i - most), min(size, i + most) + 1):
            if j == 0:
                new[j] = np.full(n, min(i, most + 1), np.int8)
                continue
            other = (a[:, i - 1] != b[:, j - 1]).astype(np.int8)
            if a_number is not None and b_number is not None:
                other += other & a_number[:, i - 1] & b_number[:, j - 1]
            best = row.get(j - 1, np.full(n, far, np.int8)) + other
            if j in row:
                best = np.minimum(best, row[j] + 1)
            if j - 1 in new:
                best = np.minimum(best, new[j - 1] + 1)
            new[j] = np.minimum(best, far).astype(np.int8)
        row = new
    return row[size]


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted values without repeats, by sorting."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


@dataclass
class Index:
    """The windows of a block of items. Equal windows are one in the buckets, however many items hold them."""

    items: list[str]
    part_item: np.ndarray  # item of each part
    words: np.ndarray
    number: np.ndarray  # which words are numbers
    start: np.ndarray  # place of each window's first word in words
    part: np.ndarray
    offset: np.ndarray
    same: np.ndarray  # windows in the order of their wording
    first: np.ndarray  # where each wording begins in `same`, and at the last place where all end
    wording: np.ndarray  # number of each window's wording
    keys: list[np.ndarray]  # sorted keys of each repetition
    order: list[np.ndarray]  # and the wordings that have them
    vocabulary: np.ndarray


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?。！？])\s+|(?<=[。！？])", text.strip()) if s]


def form(sentence: str) -> str:
    """The words of a sentence in lower case."""
    return " ".join(re.findall(r"\w+", sentence.lower()))


def own_wording(text: str, shared: frozenset[str]) -> str:
    """A question or solution without markup and without the sentences of shared wording."""
    return " ".join(s for s in sentences(plain(text)) if form(s) not in shared)


def index(parts: list[tuple[str, str]]) -> Index:
    """The index of one block of (item, own wording)."""
    g = W.grid([t for _, t in parts])
    n = len(g.hash) - WINDOW + 1
    start = np.flatnonzero(g.doc[: max(n, 0)] == g.doc[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)
    part = g.doc[start]
    wording, _ = W.shingles(g, WINDOW)
    same = np.argsort(wording, kind="stable")
    edge = np.concatenate(([True], wording[same][1:] != wording[same][:-1])) if len(same) else np.zeros(0, bool)
    first = np.flatnonzero(edge)
    number = np.zeros(len(same), np.int64)
    number[same] = np.cumsum(edge) - 1
    keys, order = [], []
    for r in range(REPEATS):
        k = embed(g.hash, start[same[first]], r)
        o = np.argsort(k, kind="stable")
        keys.append(k[o])
        order.append(o)
    names = sorted({i for i, _ in parts})
    at = {i: k for k, i in enumerate(names)}
    return Index(names, np.array([at[i] for i, _ in parts], np.int64), g.hash, numbers(g), start, part, start - g.first[part], same, np.append(first, len(same)), number, keys, order, unique(g.hash))


def search(texts: list[str], index: Index) -> list[tuple[int, str]]:
    """(number of the text, item) of each leak."""
    g = W.grid([plain(t) for t in texts])
    n = len(g.hash) - WINDOW + 1
    if n <= 0 or not len(index.start):
        return []
    known = index.vocabulary[np.minimum(np.searchsorted(index.vocabulary, g.hash), len(index.vocabulary) - 1)] == g.hash
    total = np.concatenate(([0], np.cumsum(known)))
    # a window within EDITS of an item's has all but EDITS of its words in the items' vocabulary
    at = np.flatnonzero((g.doc[:n] == g.doc[WINDOW - 1 :]) & (total[WINDOW:] - total[:-WINDOW] >= WINDOW - EDITS))
    if not len(at):
        return []
    wordings = np.int64(len(index.first) - 1)
    met, number = [np.zeros(0, np.int64)], numbers(g)
    for r in range(REPEATS):
        key = embed(g.hash, at, r)
        lo, hi = np.searchsorted(index.keys[r], key, "left"), np.searchsorted(index.keys[r], key, "right")
        count = np.cumsum(hi - lo)
        a = 0
        while a < len(at):  # a bucket that many wordings share is taken in pieces
            b = max(a + 1, int(np.searchsorted(count, (count[a - 1] if a else 0) + PAIRS, "right")))
            c = (hi - lo)[a:b]
            who = np.repeat(at[a:b], c)
            place = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[a:b], c)
            pairs = unique(who * wordings + index.order[r][place])
            met.append(pairs[_far(g, index, pairs // wordings, index.same[index.first[pairs % wordings]], number) <= EDITS])
            a = b
    hits = unique(np.concatenate(met))
    where, window, far = _verified(g, index, hits // wordings, hits % wordings)
    # other items share patterns of sentences with the one that leaked: what is farther than the item nearest at the place
    # is such a pattern, unless it is a variant within one word of what stands there
    nearest = np.full(len(g.hash), 127, np.int8)
    np.minimum.at(nearest, where, far)
    keep = far <= np.maximum(nearest[where], VARIANT)
    where, window = where[keep], window[keep]
    out = set()
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, part, offset in zip(g.doc[where].tolist(), index.part[window].tolist(), index.offset[window].tolist()):
        found.setdefault((doc, part), []).append((offset, offset + WINDOW))
    for (doc, part), spans in found.items():
        begin = end = -1
        for a, b in sorted(spans):
            if a > end:
                begin = a
            end = max(end, b)
            if end - begin >= PASSAGE:
                out.add((doc, index.items[index.part_item[part]]))
                break
    return sorted(out)


#: From a verified window to those tried next: words on in the item, and how many more or fewer on in the text.
_AROUND = [(step, step + shift) for step in (-2, -1, 1, 2) for shift in (-1, 0, 1)]


def _far(g: W.Grid, index: Index, w: np.ndarray, i: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Distance of the text's window at each place from the item's window, exact up to EDITS."""
    steps = np.arange(WINDOW)
    out = [np.zeros(0, np.int8)]
    for a in range(0, len(w), 100_000):
        x, y = w[a : a + 100_000, None] + steps, index.start[i[a : a + 100_000]][:, None] + steps
        out.append(edit_distance(g.hash[x], index.words[y], number[x], index.number[y]))
    return np.concatenate(out)


def _verified(g: W.Grid, index: Index, where: np.ndarray, wording: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, item window and distance of all pairs within EDITS: those of the wordings that were met, in every item that
    holds them, and those around each verified one until none is new."""
    size, number, last = np.int64(max(len(index.start), 1)), numbers(g), len(g.hash) - WINDOW
    count = np.diff(index.first)[wording]
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(index.first[wording], count)
    pairs = unique(np.repeat(where, count) * size + index.same[place])
    tried, kept, fars = pairs, [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
    while len(pairs):
        far = _far(g, index, pairs // size, pairs % size, number)
        pairs, far = pairs[far <= EDITS], far[far <= EDITS]
        kept.append(pairs)
        fars.append(far)
        where, window = pairs // size, pairs % size
        new = [np.zeros(0, np.int64)]
        for step, on in _AROUND:
            w, i = where + on, window + step
            ok = (w >= 0) & (w <= last) & (i >= 0) & (i < size)
            w, i, part, doc = w[ok], i[ok], index.part[window[ok]], g.doc[where[ok]]
            ok = (index.part[i] == part) & (g.doc[w] == doc) & (g.doc[w + WINDOW - 1] == doc)
            new.append(w[ok] * size + i[ok])
        pairs = unique(np.concatenate(new))
        at = np.minimum(np.searchsorted(tried, pairs), len(tried) - 1)
        pairs = pairs[tried[at] != pairs]
        tried = np.sort(np.concatenate((tried, pairs)))
    every = np.concatenate(kept)
    return every // size, every % size, np.concatenate(fars)


def shared_wording(items: DataFrame) -> frozenset[str]:
    """Sentences of shared wording, counted over all items. items: item_id, text.

    At most (sentences an item / SHARED_SHARE) sentences can stand in so many items: what comes to the driver is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(form(s), i, xxhash.xxh3_64_intdigest(form(t)) >> 1) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for s in sentences(plain(t))}
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["form", "item_id", "whole"])

    held = items.select("item_id", "text").mapInArrow(run, "form string, item_id string, whole long")
    once = held.groupBy("form", "item_id").agg(F.min("whole").alias("whole"))
    many = once.groupBy("form").agg(F.count("*").alias("n"), F.count_distinct("whole").alias("texts"))
    least = SHARED_SHARE * items.select("item_id").distinct().count()
    return frozenset(r.form for r in many.where((F.col("n") > least) & (F.col("texts") >= SHARED_TEXTS)).select("form").collect())


def blocks(items: DataFrame) -> Iterator[Index]:
    """Indexes over the questions and solutions, one block at a time; only one is held on the way."""
    shared = shared_wording(items)
    block: list[tuple[str, str]] = []
    size = 0
    for item, text in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator(prefetchPartitions=False):
        block.append((item, own_wording(text, shared)))
        size += len(text) // 4 + 1
        if size >= BLOCK_WINDOWS:
            yield index(block)
            block, size = [], 0
    if block:
        yield index(block)


def leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and item_id of each leak, once. Null, empty and short texts hold none; very long ones are read whole.

    items: item_id, text (a question or a solution), in any number. Null ids and texts are left out.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, item_id string"
    chosen = documents.select(id_column, F.col(text).alias("_text")).where(F.col("_text").isNotNull())

    def one_pass(block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts = b.column(0), b.column(1).to_pylist()
                at = size = 0
                for i, t in enumerate(texts):
                    size += len(t)
                    if size >= 1_500_000 or i == len(texts) - 1:
                        part = texts[at : i + 1]
                        hits = search(part, block.value)
                        found = ids.slice(at, len(part)).take(pa.array([d for d, _ in hits], pa.int64()))
                        yield pa.RecordBatch.from_arrays([found, pa.array([x for _, x in hits], pa.string())], [id_column, "item_id"])
                        at, size = i + 1, 0

        return chosen.mapInArrow(run, schema)

    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    passes = [one_pass(spark.sparkContext.broadcast(block)) for block in blocks(known)]
    return reduce(DataFrame.unionByName, passes).distinct() if passes else spark.createDataFrame([], schema)


def item_parts(items: DataFrame) -> DataFrame:
    """item_id, text of every question and solution."""
    return items.select("item_id", F.explode(F.array("question", "solution")).alias("text")).where("text is not null")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of test items, with the items."""
    items = item_parts(spark.read.parquet(f"{sf_dir}/eval_items.parquet"))
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), items)
