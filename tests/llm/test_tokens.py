import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import encoding as E
from millrace.llm import wordgrid as W

HAVE = os.path.exists(E.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    if not HAVE:
        pytest.skip("no vocabulary here")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(E.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def words():
    if not HAVE:
        pytest.skip("no vocabulary here")
    with open(E.VOCABULARY, "rb") as f:
        return E.Vocabulary(f.read())


def ours(texts, words):
    ids, counts = E.encode(texts, words)
    ends = np.concatenate(([0], np.cumsum(counts)))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


CASES = ["", "a", " ", "  ", "\n", " \n a", "don't we'll 's 'S '' 're'x", "x　y\xa0z", "漢字かな 123½", "<|endoftext|> x", "\r\n\r\nb", "😀 𝒜 é ​", "a" * 5000, "'" * 300, " " * 400 + "x", "\x1c\x85 ", "1'd 2'LL", "the  \t end   "]


def test_equals_library(library, words):
    want = [e.ids for e in library.encode_batch(CASES, add_special_tokens=False)]
    assert ours(CASES, words) == want
    assert [ours([c], words)[0] for c in CASES] == want  # the same in any batch


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" '\n\tsdmtrevlaé漢1½.,-!😀　\xa0")), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=40), max_size=6))
def test_round_trip_and_library(texts):
    if not HAVE:
        return
    global _T, _V
    if "_T" not in globals():
        from tokenizers import Tokenizer

        _T = Tokenizer.from_file(E.VOCABULARY.replace(".tiktoken", ".json"))
        _T.encode_special_tokens = True
        with open(E.VOCABULARY, "rb") as f:
            _V = E.Vocabulary(f.read())
    got = ours(texts, _V)
    assert [_V.decode(g) for g in got] == texts
    simple = [t for t in texts if all(ord(c) < 0x3100 or c in "漢😀" for c in t)]
    assert ours(simple, _V) == [e.ids for e in _T.encode_batch(simple, add_special_tokens=False)] or not all(c.isprintable() or c.isspace() for t in simple for c in t)


def test_scan_equals_a_plain_run():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 127, 128, 129, 5000):
        symbol = rng.integers(0, 8, n).astype(np.uint8)
        if n:
            symbol[0] += 8
        state, want = E.CLOSED, []
        for s in symbol:
            want.append(bool(E.CUT[s, state]))
            state = E.STEP[s, state]
        assert E.scan(symbol).tolist() == want


def test_merge_prefers_rank_then_left(words):
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=words.ranks, special_tokens={})
    for t in ("aaaaaaa", "hellohello", "été" * 20, "0" * 77):
        assert words.merge(t.encode()) == enc.encode_ordinary(t)


def test_frame(spark, words):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello wörld", "x"), (3, "Hello wörld", "x")], "doc_id long, text string, ids string")
    rows = E.encoded(df, "doc_id", offsets=True).collect()
    assert [r.ids for r in rows if r.doc_id < 3] == [[], []] and len(rows) == 4
    r = rows[-1]
    raw = "Hello wörld".encode()
    pieces = [raw[a:b] for a, b in zip(r.offsets, [*r.offsets[1:], len(raw)])]
    assert [words.pieces[i] for i in r.ids] == pieces
    assert E.encoded(df.limit(0), "doc_id").count() == 0


def test_grid_places_and_hashes():
    g = W.grid(["Ab, 12x", "", "漢字 ab", None])
    assert g.counts().tolist() == [2, 0, 3, 0]
    assert g.hash[0] == g.hash[4]  # case-blind, whatever the place
    assert ["".join(map(chr, g.points[a:b])) for a, b in zip(g.start, g.end)] == ["ab", "12x", "漢", "字", "ab"]
    h, at = W.shingles(g, 2)
    assert at.tolist() == [0, 2, 3]
    assert W.grid([]).counts().tolist() == []
    m = W.grid(["7 x 88"], digits="mask")
    assert m.hash[0] == m.hash[2]
