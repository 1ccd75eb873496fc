"""Problem 6: byte-pair encoding of a whole corpus with a public vocabulary.

Method: code points become class arrays; word boundaries are found by an associative scan over transition functions of
a small automaton, without regular expressions; the slices between boundaries go through a cached pair merge. One pass
over the rows, no shuffle. Special tokens are never produced: their spelling in a text is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where the vocabulary lies; every function here takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE = range(6)
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The English contractions that are words of their own, after the apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

# States of the automaton after a code point, and its symbols. CLOSED also stands for a text's beginning.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_BLANKS, ALONE, TWO_MORE, ONE_MORE, CLOSED = range(9)
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_BLANK, S_JOIN, S_ALONE = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a word begins, for each symbol (those from 8 on begin a text) and state."""
    step, cut = np.zeros((16, 9), np.uint8), np.zeros((16, 9), bool)
    for state in range(9):
        def put(symbol: int, to: int, begins: bool) -> None:
            step[symbol, state], cut[symbol, state] = to, begins  # noqa: B023

        if state == TWO_MORE:
            put(S_LETTER, ONE_MORE, False)
        elif state == ONE_MORE:
            put(S_LETTER, CLOSED, False)
        else:
            put(S_LETTER, IN_LETTERS, state not in (IN_LETTERS, JOINING))
        put(S_NUMBER, IN_NUMBERS, state not in (IN_NUMBERS, JOINING))
        attached = state in (IN_OTHERS, JOINING)
        put(S_OTHER, IN_OTHERS, not attached)
        put(S_SHORT, IN_OTHERS if attached else ONE_MORE, not attached)
        put(S_LONG, IN_OTHERS if attached else TWO_MORE, not attached)
        put(S_BLANK, IN_BLANKS, state != IN_BLANKS)
        put(S_JOIN, JOINING, True)
        put(S_ALONE, ALONE, True)
    for symbol in range(8):
        step[8 + symbol], cut[8 + symbol] = step[symbol, CLOSED], True
    return step, cut


STEP, CUT = _automaton()
BLOCK = 128


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    table = np.full(0x10000, OTHER, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[WHITE_SPACE] = BLANK
    table[0x20], table[0x27] = SPACE, QUOTE
    return table


def kinds(points: np.ndarray) -> np.ndarray:
    out = _kinds()[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        for c in np.unique(points[high]):
            kind = unicodedata.category(chr(int(c)))[0]
            out[points == c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    return out


def symbols(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The automaton's symbol for each code point; begins: where texts start."""
    n = len(points)
    kind = kinds(points)
    opens = np.zeros(n + 1, bool)
    opens[begins[begins < n]] = True
    opens[n] = True
    table = np.array([S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_BLANK, S_OTHER], np.uint8)
    out = table[kind]
    blank = (kind == SPACE) | (kind == BLANK)
    last = blank & ~np.concatenate((blank[1:], [True])) & ~opens[1:]  # the next code point is of this text and not blank
    out[last] = np.where(kind[last] == SPACE, S_JOIN, S_ALONE)
    quotes = np.flatnonzero(kind == QUOTE)
    if len(quotes):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = ~opens[np.minimum(quotes + 1, n)]
        two = one & ~opens[np.minimum(quotes + 2, n)]
        for ending in CONTRACTIONS:
            fits = (one & (a == ord(ending))) if len(ending) == 1 else (two & (a == ord(ending[0])) & (b == ord(ending[1])))
            out[quotes[fits]] = S_SHORT if len(ending) == 1 else S_LONG
    out[begins[begins < n]] += 8
    return out


def scan(symbol: np.ndarray) -> np.ndarray:
    """Whether a word begins at each symbol. Blocks are summed to transition functions, the functions are composed by
    doubling over the blocks, and every block is then run from its known entry state, all blocks side by side."""
    n = len(symbol)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, 8 + S_LETTER, np.uint8)
    padded[:n] = symbol
    grid = padded.reshape(rows, BLOCK).T.copy()
    function = np.tile(np.arange(9, dtype=np.uint8), (rows, 1))
    for line in grid:
        function = STEP[line[:, None], function]
    gap = 1
    while gap < rows:
        joined = np.take_along_axis(function[gap:], function[:-gap], 1)
        function = np.concatenate((function[:gap], joined))
        gap *= 2
    state = np.concatenate(([np.uint8(CLOSED)], function[:-1, CLOSED]))
    begins = np.empty((BLOCK, rows), bool)
    for j, line in enumerate(grid):
        begins[j] = CUT[line, state]
        state = STEP[line, state]
    return begins.T.reshape(-1)[:n]


class Vocabulary(dict):
    """Ids of a slice of text; merged once, then remembered. Forgets everything when KEPT slices are held."""

    KEPT = 1_000_000

    def __init__(self, lines: bytes) -> None:
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        top = max(self.ranks.values()) + 1
        self.pieces = [b""] * top
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.sizes = np.array([len(p) for p in self.pieces], np.int32)

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= self.KEPT:
            self.clear()
        ids = self.merge(piece.encode("utf-8", "replace"))
        self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Joins the neighbours of lowest rank, leftmost first, until none is in the vocabulary."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        parts = [raw[i : i + 1] for i in range(len(raw))]
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = b""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [ranks[p] for p in parts if p]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(lines: bytes) -> Vocabulary:
    """One vocabulary for each worker process."""
    return Vocabulary(lines)


def slices(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all texts in order, and how many each text has."""
    joined = "".join(texts)
    if not joined:
        return [], np.zeros(len(texts), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    filled = np.unique(begins[:-1][lengths > 0])
    at = np.flatnonzero(scan(symbols(points, filled)))
    edges = np.concatenate((at, [len(points)])).tolist()
    return [joined[a:b] for a, b in zip(edges, edges[1:])], np.diff(np.searchsorted(at, begins))


def encode(texts: list[str], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and how many each text has."""
    parts, counts = slices(texts)
    found = [words[p] for p in parts]
    sizes = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
    ends = np.concatenate(([0], np.cumsum(counts)))
    ids = np.fromiter(chain.from_iterable(found), np.int32, sizes[-1])
    return ids, np.diff(sizes[ends])


#: Texts are encoded in parts of about so many characters, to bound a worker's memory.
PART = 2_000_000


def encoded(df: DataFrame, id_column: str, text: str = "text", path: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """The id column, `ids` and, if wanted, `offsets`: the byte of the text at which each id begins.

    Null and empty texts have an empty list. Texts are encoded whole, whatever their length; repeated rows stay.
    """
    with open(path, "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read())
    schema = f"{id_column} {df.schema[id_column].dataType.simpleString()}, ids array<int>" + ", offsets array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(lines.value)
        for batch in batches:
            size, at = 0, 0
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, t in enumerate(texts):
                size += len(t)
                if size >= PART or i == len(texts) - 1:
                    ids, counts = encode(texts[at : i + 1], words)
                    edges = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                    columns = [batch.column(0).slice(at, i + 1 - at), pa.ListArray.from_arrays(edges, pa.array(ids))]
                    if offsets:
                        total = np.concatenate(([0], np.cumsum(words.sizes[ids])))
                        starts = np.repeat(total[np.concatenate(([0], np.cumsum(counts)))[:-1]], counts)
                        columns.append(pa.ListArray.from_arrays(edges, pa.array((total[:-1] - starts).astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, [id_column, "ids", *["offsets"] * offsets])
                    size, at = 0, i + 1

    return df.select(id_column, F.col(text).alias("_text")).mapInArrow(run, schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
