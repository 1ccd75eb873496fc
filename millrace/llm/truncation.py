"""Problem 4: texts that were cut, and how often each source cuts.

Method: near-copies are found by min-hash banding. A cut copy is like the beginning of its whole and not like all of it, so
bands are made of beginnings: of the first 5, 8, 11, 16, 22 ... words (each level about 1.4 times the one before) the
min-hashes of five-word shingles, with the two words that follow. A text whose end is open meets, at its four highest
levels, every longer text of each band it shares; a near-copy of the other's beginning, verified by shingle containment,
whose alignment ends inside a word or sentence of it is cut. In large bands the longest text is met first, and who is not
settled by it meets those that hold one of its rarest shingles, or how it ends, of which a near-copy can't lack all. Records that no copy settles are scored by the terminality of their closing word: end marks and forms of an
answer are terminal; another word is as terminal as it is, over all texts, the close of a line without an end mark.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import records, repetition
from millrace.llm import wordgrid as W
from millrace.session import written

SHINGLE, SIMILARITY = 5, 0.8
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bands of each level, min-hashes of each band, words after the level that must be equal, levels at which a text looks.
BANDS, ROWS, FOLLOWING, LOOKED = 2, 1, 2, 4
#: Members of a band up to which all are met outright; those of a larger band are met by their shingles.
DIRECT = 64
#: Rows of a look-up table that may be broadcast; a larger one is joined by shuffling.
LOOKUP_ROWS = 200_000
#: A closing word without an end mark is terminal if it ends an unmarked line in at least this share of its places.
TERMINAL = 0.5
#: Share of a text that must repeat for its end to be an endless repetition.
ENDLESS = 0.4

END_MARKS = ".!?。！？…"
_CLOSERS = "\"'”’»)]}*_」』）】"
#: Forms of a bare final answer, complete without an end mark.
_ANSWER = re.compile(r"(?:####\s*[^\s#]+|\\boxed\{[^{}]*\}\$?|```\s*\n[^`]*\n?```|(?i:answer|antwort|ergebnis|résultat|réponse|resultado|respuesta|result|答案|结果)\s*[:：]\s*\S+|</\w+>)\s*$")
#: Characters of a bare answer at most; a longer run of digits is a loop.
BARE = 40
_BARE = re.compile(r"\s*[-+]?\$?[\d.,/]+%?\s*$|\s*\(?[A-J]\)?\s*$")


def blank(text: str | None) -> bool:
    """Whether nothing can be seen: white space, zero-width characters or empty markup only."""
    if not text:
        return True
    if text.lstrip()[:1].isalnum():  # nothing that can't be seen begins so
        return False
    rest = re.sub(r"<(think|answer|b|p|div|span)>\s*</\1>|\\(?:boxed|text)\{\s*\}|```\w*\s*```|<[^<>]*>|[\s​-‏⁠﻿\xad]", "", text)
    return not rest or not re.sub(r"[`$*_#>|~-]", "", rest)


def open_marks(text: str) -> bool:
    """Whether a fence or a box is left open."""
    if text.count("```") % 2:
        return True
    at = text.rfind("\\boxed{")
    return at >= 0 and text.count("{", at) > text.count("}", at)


_LAST_WORD = re.compile(r"\W*([^\W\d_]+)")


def _answers(t: str) -> bool:
    """Whether a text without space at its end ends in a form of `_ANSWER`. All but boxes and fences are of three pieces
    between spaces at most, and those two begin at the last mark of their kind."""
    pieces = t.rsplit(None, 3)
    if _ANSWER.search(t, len(pieces[0]) if len(pieces) > 3 else 0):
        return True
    if t.endswith(("}", "}$")):
        at = t.rfind("\\boxed{")
    else:
        at = t.rfind("```", 0, len(t) - 3) if t.endswith("```") else -1
    return at >= 0 and _ANSWER.match(t, at) is not None


def closing(text: str) -> tuple[str, str]:
    """How a text ends: ('end' | 'answer' | 'open' | 'word' | 'blank', its last word in lower case)."""
    if blank(text):
        return "blank", ""
    t = text.rstrip().rstrip("​‌‍﻿").rstrip()
    if open_marks(t):
        return "open", ""
    if _answers(t) or len(t) <= BARE and _BARE.fullmatch(t):
        return "answer", ""
    if t.rstrip(_CLOSERS)[-1:] and t.rstrip(_CLOSERS)[-1] in END_MARKS:
        return "end", ""
    m = _LAST_WORD.match(t[::-1])  # read from the end, in time that doesn't grow with the words before it
    word = m[1][::-1].lower() if m else ""
    if word and ord(word[-1]) > 0x2E80:
        word = word[-1]
    return "word", word


_ANY_WORD = re.compile(r"[^\W\d_]+")


def closing_counts(texts: list[str]) -> dict[str, list[int]]:
    """For each word how often it occurs, and how often it closes a line without an end mark with more text below."""
    every: Counter[str] = Counter()
    closes: Counter[str] = Counter()
    for t in texts:
        low = t.lower()
        every.update(_ANY_WORD.findall(low))
        if "\n" in low:
            ends = (_ANY_WORD.match(line.removesuffix("\r").rstrip(" \t")[::-1]) for line in low.rstrip().split("\n")[:-1])
            closes.update(m[0][::-1] for m in ends if m)
    out: dict[str, list[int]] = {}
    for w, n in every.items():
        c = out.setdefault(w[-1] if ord(w[-1]) > 0x2E80 else w, [0, 0])
        c[0] += n
        c[1] += closes[w]
    return out


# ------------------------------------------------------------------------------------------------ near-copies
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def levels(words: int) -> list[int]:
    """Lengths of the beginnings that a text of so many words has bands for; its last word may be cut and is left out."""
    out, size = [], float(SHINGLE)
    while int(size) + FOLLOWING < words:
        out.append(int(size))
        size = max(size * 2**0.5, size + 3)
    return out


def reach(level: int) -> tuple[int, int]:
    """Words of a level, and of the beginnings that a text which looks at it can align with."""
    sizes = [float(SHINGLE)]
    for _ in range(level + LOOKED):
        sizes.append(max(sizes[-1] * 2**0.5, sizes[-1] + 3))
    longest = int(sizes[-1]) + FOLLOWING
    return int(sizes[level]), longest + longest // 4 + SHINGLE


def _folded(text: str) -> str:
    """Lower case letter by letter, so that a beginning is folded as its whole is."""
    low = text.lower()
    return (low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)).replace("ς", "σ")


POSTED = "text_key binary, size int, key long, level int, way int, need int"


def posted(texts: list[str], places: list[list[tuple[int, bool]]]) -> tuple[np.ndarray, ...]:
    """For each text and each (level, looks) of it rows of text, key, level, way, need: the keys by which it may be met there, of
    level -1, and where it looks those it asks for, in two ways. Texts of one band have the words after its level in common,
    which go into each key; a text that another is an early end of has, where it can align,
    way 0: one of any `need` of its shingles but for that of its last word, which may be cut;
    way 1: its last word, or the word before it with one after that begins with the same letter.
    """
    g = W.grid([_folded(t) for t in texts], lower=False)
    h, at = W.shingles(g, SHINGLE)
    letters, which = np.unique(g.points[g.start], return_inverse=True)
    lead = np.array([ord(chr(c).lower()[0]) for c in letters], np.uint64)[which]
    text, level, looks = np.array([(d, x, y) for d, p in enumerate(places) for x, y in p], np.int64).reshape(-1, 3).T
    size, stop = np.array([reach(x) for x in range(level.max(initial=0) + 1)]).T
    salt = level.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(FOLLOWING):
            salt = W.mix(salt * _MULT ^ g.hash[g.first[text] + size[level] + k])
        word = W.mix(g.hash + np.uint64(1))
        ending = W.mix(g.hash[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ lead[1:])
    edges = np.searchsorted(at, g.first)
    shingles, words = edges[text + 1] - edges[text], g.counts()[text]

    def keys(source: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and key of each of the first n values of each place."""
        place = np.repeat(np.arange(len(n)), n)
        with np.errstate(over="ignore"):
            found = W.mix(source[begin[place] + np.arange(len(place)) - (np.cumsum(n) - n)[place]] * _MULT ^ salt[place]).view(np.int64)
        return place, found

    def once(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        place, found = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((found, place))
        place, found = place[order], found[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (found[1:] != found[:-1])
        return place[new], found[new]

    first, part = g.first[text], stop[level]
    held = once(keys(h, edges[text], np.minimum(shingles, part)), keys(word, first, np.minimum(words, part)), keys(ending, first, np.minimum(words - 1, part)))
    sure = once(keys(h, edges[text], np.where(looks, shingles - 1, 0)))
    last = once(keys(word, first + words - 1, looks), keys(ending, first + words - 2, looks))
    need = shingles - np.ceil(SIMILARITY * shingles - 1e-9).astype(np.int64) + 1
    place = np.concatenate((held[0], sure[0], last[0]))
    way = np.repeat([-1, 0, 1], [len(held[0]), len(sure[0]), len(last[0])])
    return text[place], np.concatenate((held[1], sure[1], last[1])), np.where(way < 0, -1, level[place]), way, np.where(way == 0, need[place], 2)


def bands(texts: list[str]) -> list[list[int]]:
    """Band keys of each text, BANDS for each level from the lowest; a text of fewer than eight words has none."""
    g = W.grid(texts)
    h, at = W.shingles(g, SHINGLE)
    out: list[list[int]] = [[] for _ in texts]
    count = g.counts()
    has = np.flatnonzero(count > SHINGLE + FOLLOWING)
    if not len(has):
        return out
    size = np.array(levels(int(count.max())))
    known = np.searchsorted(size + FOLLOWING, count[has], "left")  # levels of each text
    first = np.searchsorted(at, g.first[has])  # its first shingle
    # shingles that each level adds to the one before: a level of n words has n - SHINGLE + 1
    steps = np.concatenate(([0], size - SHINGLE + 1))
    text = np.repeat(np.arange(len(has)), known + 1)
    place = np.arange(len(text)) - np.repeat(np.cumsum(known + 1) - (known + 1), known + 1)
    edges = first[text] + steps[place]
    inner = place < known[text]
    mult, add = _seeds(BANDS * ROWS)
    keys = np.empty((len(has), len(size), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        level = np.arange(len(size))
        follow = np.minimum(g.first[has][:, None] + size[None, :], len(g.hash) - FOLLOWING)
        after = W.mix(level.astype(np.uint64) + np.uint64(1))[None, :] * np.ones((len(has), 1), np.uint64)
        for k in range(FOLLOWING):
            after = W.mix(after * np.uint64(0x9E3779B97F4A7C15) ^ g.hash[follow + k])
        for b in range(BANDS):
            key = after + np.uint64(b + 1)
            for r in range(ROWS):
                x = h * mult[b * ROWS + r] + add[b * ROWS + r]
                least = np.minimum.reduceat(x ^ (x >> np.uint64(29)), edges)
                grid = np.full((len(has), len(size)), np.iinfo(np.uint64).max, np.uint64)
                grid[text[inner], place[inner]] = least[inner]
                key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.accumulate(grid, 1))
            keys[:, :, b] = key
    for d, n, row in zip(has.tolist(), known.tolist(), keys.view(np.int64)):
        out[d] = row[:n].ravel().tolist()
    return out


def ends_early(short: str, long: str) -> bool:
    """Whether `short` is a near-copy of the beginning of `long` that stops inside a word or a sentence of it."""
    a, b = short.rstrip(), long.rstrip()
    if not a or len(b) <= len(a):
        return False
    if b.startswith(a):
        at = len(a)
    else:
        g = W.grid([a, b])
        ha, hb = g.hash[: g.first[1]].tolist(), g.hash[g.first[1] :].tolist()
        if len(ha) < SHINGLE or len(hb) < SHINGLE:
            return False
        whole, hb = len(hb), hb[: len(ha) + len(ha) // 4 + SHINGLE]  # the part that a copy of this length can align with
        sa, sb = set(zip(*(ha[i:] for i in range(SHINGLE)))), set(zip(*(hb[i:] for i in range(SHINGLE))))
        if len(sa & sb) < SIMILARITY * len(sa):
            return False
        blocks = SequenceMatcher(None, ha, hb, autojunk=False).get_matching_blocks()[:-1]
        if not blocks:
            return False
        last = blocks[-1]
        tail, other = len(ha) - (last.a + last.size), last.b + last.size
        if tail > 1 or other >= whole:
            return False
        begins = int(g.begins[1])
        if tail == 1:  # the last word may be the beginning of the other's word
            x = a[int(g.start[g.first[1] - 1]) : int(g.end[g.first[1] - 1])].lower()
            y = b[int(g.start[g.first[1] + other]) - begins : int(g.end[g.first[1] + other]) - begins].lower()
            return y.startswith(x) and y != x and a[-1].isalnum()
        at = int(g.end[g.first[1] + other - 1]) - begins
        if not a[-1].isalnum():
            return a[-1] not in END_MARKS and a[-1] not in _CLOSERS
    before, after = b[at - 1], b[at]
    if before.isalnum() and after.isalnum():
        return True
    return before not in END_MARKS + _CLOSERS.replace("*", "").replace("_", "") and a[-1] not in END_MARKS and closing(a)[0] in ("word", "open")


def may_end_early(shorts: list[str], longs: list[str]) -> list[bool]:
    """Of each pair, whether the long text begins with the short one or holds SIMILARITY of its shingles where a copy could
    align: without that `ends_early` is false. Each text of a batch is cut into words once."""
    shorts, longs = [t.rstrip() for t in shorts], [t.rstrip() for t in longs]
    place = {t: i for i, t in enumerate(dict.fromkeys(shorts + longs))}
    g = W.grid(list(place))
    h, at = W.shingles(g, SHINGLE)
    edges, own, words = np.searchsorted(at, g.first).tolist(), h.tolist(), g.counts().tolist()
    sets: dict[int, set[int]] = {}
    lasts: dict[int, set[int]] = {}  # of a short text so many shingles that without them too few are left
    wholes: dict[int, set[int]] = {}
    firsts: dict[int, dict[int, int]] = {}
    out = []
    for a, b in zip(shorts, longs):
        i, j = place[a], place[b]
        if len(b) <= len(a) or not a:
            out.append(False)
            continue
        if b.startswith(a):
            out.append(True)
            continue
        if i not in sets:
            sets[i] = set(own[edges[i] : edges[i + 1]])
            lasts[i] = set(own[max(edges[i], edges[i + 1] - int((1 - SIMILARITY) * len(sets[i])) - 2) : edges[i + 1]])
        if j not in wholes:
            wholes[j] = set(own[edges[j] : edges[j + 1]])
        least = SIMILARITY * len(sets[i])
        if len(sets[i]) - len(lasts[i]) < least and lasts[i].isdisjoint(wholes[j]) or len(shared := sets[i] & wholes[j]) < least:
            out.append(False)
            continue
        if j not in firsts:
            n = edges[j + 1] - edges[j]
            firsts[j] = dict(zip(reversed(own[edges[j] : edges[j + 1]]), range(n - 1, -1, -1)))
        stop, held = words[i] + words[i] // 4 + 1, firsts[j]  # shingles that begin before it lie in the part that can align
        out.append(sum(held[x] < stop for x in shared) >= least)
    return out


SCHEMA = "src string, record_id long, data_source string, n int, text_key binary, text string, form string, word string, loops double, keys array<long>, defects array<string>"
#: Records worked on at once in a worker.
CHUNK = 2000


def measured(rollout: DataFrame | None, vocab: DataFrame | None, evals: DataFrame | None, judge: Callable[[str | None, str | None], list[str]] | None = None) -> DataFrame:
    """Every record with what the later steps need of its text, in one pass over each table: SCHEMA.

    judge: gives the defects of (prompt, response). Records without a text have a null text_key and form 'blank'.
    """
    forest = repetition.model()

    def measure(src: str, ids: pa.Array, source: pa.Array, n: pa.Array, text: pa.Array, prompt: pa.Array | None) -> pa.RecordBatch:
        texts = [t or "" for t in text.to_pylist()]
        ends = [closing(t) for t in texts]
        loops = np.zeros(len(texts))
        # endless repetition counts at a source's limit only, which no record without a token count can be at
        counted = n.is_valid().to_pylist()
        loose = [i for i, (f, _) in enumerate(ends) if counted[i] and f not in ("blank", "answer")]
        if loose:
            loops[loose] = np.clip(forest.score(repetition.statistics([texts[i] for i in loose])), 0, 1)
        prompts = prompt.to_pylist() if prompt is not None else [None] * len(texts)
        found = [judge(p, t) for p, t in zip(prompts, texts)] if judge else [[]] * len(texts)
        arrays = [pa.array([src] * len(texts)), ids, source, n, pa.array([xxhash.xxh3_128_digest(t) if t else None for t in texts], pa.binary()), pa.array([t or None for t in texts], pa.string()), pa.array([f for f, _ in ends]), pa.array([w for _, w in ends]), pa.array(loops), pa.array(bands(texts), pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])

    parts = []
    if rollout is not None:
        pieces = records.vocabulary(vocab)

        def of_rollout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(pieces, pa.string())
            for b in (whole.slice(i, CHUNK) for whole in batches for i in range(0, whole.num_rows, CHUNK)):
                c = records.opened(b, known, judge is not None)
                yield measure("rollout", c["row_idx"], c["data_source"], c["n"], c["response"], c.get("prompt"))

        parts.append(rollout.select(*records.token_columns(judge is not None)).mapInArrow(of_rollout, SCHEMA))
    if evals is not None:

        def of_evals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(i, CHUNK) for whole in batches for i in range(0, whole.num_rows, CHUNK)):
                yield measure("eval_results", b.column(0), pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.int32()), b.column(2), b.column(1))

        parts.append(records.judged_pairs(evals).select("result_id", "prompt", "response").mapInArrow(of_evals, SCHEMA))
    return reduce(DataFrame.unionByName, parts)


#: What Python takes for white space.
_SPACE = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def aligned_early(texts: DataFrame) -> DataFrame:
    """text_key of near-copies of the beginning of a longer text whose alignment with it ends early.

    texts: text_key, text, form, keys; copies may repeat. Only texts whose end is open look, at their LOOKED highest levels;
    of each band they meet every longer text. Bands of up to DIRECT members are joined with themselves. In a larger one, a
    text that its longest member settles is done; the others are met through `posted` keys, in the way that meets fewest, so
    that the work follows the texts that are alike and not the square of the band.
    """
    known = texts.where(F.size("keys") > 0)
    single = known.groupBy("text_key").agg(F.first(F.length("text")).alias("size"), F.first(F.length(F.rtrim("text", F.lit(_SPACE)))).alias("seen"), F.first("keys").alias("keys"), F.first("form").alias("form"))
    single = written(single, "single")
    looks = ~F.col("form").isin("end", "blank") & (F.col("pos") >= F.size("keys") - LOOKED * BANDS)
    member = single.select("*", F.posexplode("keys").alias("pos", "band")).select("text_key", "size", "seen", "pos", "band", looks.alias("looks"))
    sizes = member.groupBy("band").agg(F.count("*").alias("n"), F.max("looks").alias("sought"), F.max(F.struct("size", "text_key")).alias("top"))
    sizes = written(sizes.where("n > 1 and sought").select("band", "n", F.col("top.text_key").alias("longest")), "bands")
    shared = written(member.join(F.broadcast(sizes) if sizes.count() <= LOOKUP_ROWS else sizes, "band"), "members")
    looking, hot = shared.where("looks"), shared.where(F.col("n") > DIRECT)
    other = shared.where(F.col("n") <= DIRECT).select("band", F.col("text_key").alias("other"), F.col("size").alias("_size"))
    few = looking.where(F.col("n") <= DIRECT).join(other, "band").where("text_key <> other and _size > seen").select("text_key", "other")
    first = hot.where("looks and text_key <> longest").select("text_key", F.col("longest").alias("other"))
    early = written(_verified(few.union(first).distinct(), known), "early")
    return early.union(_verified(_alike(hot, early, known), known)).distinct()


def _alike(hot: DataFrame, settled: DataFrame, known: DataFrame) -> DataFrame:
    """text_key, other: texts of large bands that look and aren't settled, with each longer one that holds one of their rarest keys."""
    level = hot.groupBy("text_key", F.expr(f"pos div {BANDS}").alias("level")).agg(F.first("size").alias("size"), F.first("seen").alias("seen"), F.max("looks").alias("looks"))
    level = level.join(settled.withColumn("done", F.lit(True)), "text_key", "left")
    places = level.groupBy("text_key").agg(F.first("size").alias("size"), F.first("seen").alias("seen"), F.collect_list(F.struct("level", F.expr("looks and done is null"))).alias("places"))
    whole = places.join(known.select("text_key", "text"), "text_key").dropDuplicates(["text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, CHUNK) for whole in batches for i in range(0, whole.num_rows, CHUNK)):
            size, seen = (b.column(k).to_pylist() for k in (1, 2))
            text, key, level, way, need = posted(b.column(4).to_pylist(), [[tuple(p.values()) for p in x] for x in b.column(3).to_pylist()])
            sizes = np.where(way < 0, np.array(size, np.int32)[text], np.array(seen, np.int32)[text])
            arrays = [b.column(0).take(pa.array(text)), pa.array(sizes, pa.int32()), pa.array(key), *(pa.array(x, pa.int32()) for x in (level, way, need))]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in POSTED.split(", ")])

    rows = written(whole.select("text_key", "size", "seen", "places", "text").mapInArrow(run, POSTED), "posted")
    held = rows.where("level < 0").select("key", F.col("text_key").alias("other"), F.col("size").alias("_size"))
    often = held.groupBy("key").agg(F.count("*").alias("often"))
    # windows over a text's own keys at a level
    rank = F.row_number().over(Window.partitionBy("text_key", "level", "way").orderBy("often", "key"))
    asked = rows.where("level >= 0").join(often, "key").withColumn("rank", rank).where("rank <= need")
    asked = asked.withColumn("met", F.sum("often").over(Window.partitionBy("text_key", "level", "way")))
    asked = asked.withColumn("best", F.min(F.struct("met", "way")).over(Window.partitionBy("text_key", "level"))).where("way = best.way and often > 1")
    return asked.join(held, "key").where("text_key <> other and _size > size").select("text_key", "other").distinct()


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """text_key of the pairs whose text ends early in the other."""
    pairs = written(pairs, "pairs")
    needed = pairs.select("text_key").union(pairs.select("other")).distinct()
    few = known.select("text_key", "text").join(needed, "text_key", "left_semi").dropDuplicates(["text_key"])
    few = written(few, "texts")
    both = pairs.join(few.withColumnRenamed("text", "short"), "text_key").join(few.select(F.col("text_key").alias("other"), F.col("text").alias("long")), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shorts, longs = (batch.column(i).to_pylist() for i in range(3))
            hit = [k for k, s, t, x in zip(keys, shorts, longs, may_end_early(shorts, longs)) if x and ends_early(s, t)]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.binary())], ["text_key"])

    return both.select("text_key", "short", "long").mapInArrow(run, "text_key binary").distinct()


def word_terminality(texts: DataFrame) -> DataFrame:
    """word, share: how often each word closes an unmarked line, over all texts; summed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for b in batches:
            for w, (n, closes) in closing_counts([t for t in b.column(0).to_pylist() if t]).items():
                c = counts.setdefault(w, [0, 0])
                c[0] += n
                c[1] += closes
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    counts = texts.select("text").mapInArrow(run, "word string, n long, closes long")
    return counts.groupBy("word").agg(((F.sum("closes") + 0.5) / (F.sum("n") + 5)).alias("share"))


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array([c[0] for c in counts.values()], pa.int64()), "closes": pa.array([c[1] for c in counts.values()], pa.int64())})


def lookup(df: DataFrame) -> DataFrame:
    """A small table to be broadcast, if it is one: its rows are counted as they come, and beyond LOOKUP_ROWS it stays as it
    is, to be joined by shuffling."""
    rows = df.limit(LOOKUP_ROWS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= LOOKUP_ROWS else df


#: Ways by which a record is found to be cut.
ROUTES = ["alignment", "open_mark", "endless", "closing_word"]


def cut_routes(measured: DataFrame) -> DataFrame:
    """src, record_id, route: every way by which a record is cut; a record may have several. measured: SCHEMA, written.

    Endless repetition counts at the source's limit, which is the most visible tokens any record of the source has; sources in
    other case are the same. A record of no source is at the limit if any source has that limit. The table of evaluations has no
    token counts and so no limit that could be reached: what repeats there may be whole, and only its ending counts.
    """
    slim = measured.select("src", "record_id", F.lower(F.trim("data_source")).alias("_key"), "n", "text_key", "form", "word", ((F.col("loops") >= ENDLESS) & ~F.col("form").isin("blank", "answer")).alias("endless"))
    limits = lookup(slim.where("_key is not null and n is not null").groupBy("_key").agg(F.max("n").alias("_limit")))
    endless = slim.where("endless")
    named = endless.join(limits, "_key").where("n >= _limit").select("src", "record_id")
    nameless = endless.where("_key is null and n is not null").join(lookup(limits.select(F.col("_limit").alias("n")).distinct()), "n", "left_semi").select("src", "record_id")
    looping = named.union(nameless)
    # words that end unmarked lines are few beside all words: they are what is looked up
    closers = lookup(word_terminality(measured).where(F.col("share") >= TERMINAL).select("word"))
    loose = slim.where("form = 'word'").join(closers, "word", "left_anti").select("src", "record_id")
    early = slim.join(aligned_early(measured), "text_key", "left_semi").select("src", "record_id")
    parts = zip(ROUTES, (early, slim.where("form = 'open'").select("src", "record_id"), looping, loose))
    return reduce(DataFrame.union, [p.withColumn("route", F.lit(r)) for r, p in parts])


def cut_records(measured: DataFrame) -> DataFrame:
    """src, record_id, data_source, cut, defects of every record, each id once. Null, empty and blank texts are not cut."""
    cut = cut_routes(measured).select("src", "record_id")
    slim = measured.select("src", "record_id", "data_source", "defects")
    every = slim.withColumn("cut", F.lit(False)).unionByName(cut.select("src", "record_id", F.lit(None).cast("string").alias("data_source"), F.lit(None).cast("array<string>").alias("defects"), F.lit(True).alias("cut")))
    return every.groupBy("src", "record_id").agg(F.max("data_source").alias("data_source"), F.max("cut").alias("cut"), F.max("defects").alias("defects"))


def rollout_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return written(measured(read("rollout"), read("vocab"), None), "records")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts whose visible text is cut."""
    return cut_records(rollout_records(spark, sf_dir)).where("cut").select(F.col("record_id").alias("row_idx"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: records, cut records and their share. Sources in other case are one; null stays null."""
    found = cut_records(rollout_records(spark, sf_dir))
    rates = found.groupBy(F.lower(F.trim("data_source")).alias("data_source")).agg(F.count("*").alias("records"), F.count_if("cut").alias("cut_records"))
    return rates.withColumn("cut_share", F.round(F.col("cut_records") / F.col("records"), 6))
