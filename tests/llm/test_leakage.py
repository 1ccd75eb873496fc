import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import leakage as K

RNG = random.Random(8)
WORDS = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in "rstnl"]
ITEMS = [(f"i{k}", " ".join(RNG.choice(WORDS) for _ in range(30)) + ". Work through every part and put the outcome alone on the last line.") for k in range(60)]


SHARED = frozenset(["work through every part and put the outcome alone on the last line"])


def index(items=ITEMS):
    return K.index([(i, K.own_wording(t, SHARED)) for i, t in items])


def leaks(texts):
    return {x for x in K.search(texts, index())}


def test_forms_of_leaks():
    q = ITEMS[7][1].split(".")[0]
    w = q.split()
    swapped = w[:]
    swapped[5], swapped[17] = "other", "words"
    lines = "\n".join("> " + " ".join(w[i : i + 5]) for i in range(0, 30, 5))
    cut = " ".join(w[:10]) + " " + w[10][:2] + "-\n" + w[10][2:] + " " + " ".join(w[11:])
    texts = ["x y z " + q, q.upper(), "  ".join(w), " ".join(swapped), lines, cut, " ".join(f"<b>{x}</b>&nbsp;" for x in w), " ".join(w[3:17]), " ".join(w[:9]) + " nothing else of it here", "Work through every part and put the outcome alone on the last line.", "", "short"]
    assert {d for d, i in leaks(texts)} == set(range(8)) and {i for _, i in leaks(texts)} == {"i7"}


def test_recall_against_brute_force():
    rng = np.random.default_rng(5)
    texts, want = [], set()
    for n in range(300):
        k = int(rng.integers(60))
        w = ITEMS[k][1].split(".")[0].split()
        a = int(rng.integers(0, 12))
        part = [x if rng.random() > 0.06 else RNG.choice(WORDS) for x in w[a : a + 18]]
        texts.append(" ".join(RNG.choice(WORDS) for _ in range(20)) + " " + " ".join(part) + " " + " ".join(RNG.choice(WORDS) for _ in range(20)))
    idx = index()
    got = set(K.search(texts, idx))
    g, start = K.W.grid(texts), idx.start
    for d in range(len(texts)):  # every window with every window of the items
        at = np.arange(g.first[d], g.first[d + 1] - K.WINDOW + 1)
        a = g.hash[at[:, None] + np.arange(K.WINDOW)]
        b = idx.words[start[:, None] + np.arange(K.WINDOW)]
        pairs = [(i, j) for i in range(len(a)) for j in np.flatnonzero((a[i] == b).sum(1) >= 4)]
        far = K.edit_distance(a[[i for i, _ in pairs]], b[[j for _, j in pairs]]) if pairs else []
        hits: dict[int, set[int]] = {}
        for (i, j), f in zip(pairs, far):
            if f <= K.EDITS:
                hits.setdefault(int(idx.part[j]), set()).update(range(int(idx.offset[j]), int(idx.offset[j]) + K.WINDOW))
        for part, covered in hits.items():
            run = best = 0
            for o in range(max(covered) + 1):
                run = run + 1 if o in covered else 0
                best = max(best, run)
            if best >= K.PASSAGE:
                want.add((d, idx.items[idx.part_item[part]]))
    assert len(got & want) >= 0.98 * len(want) > 200 and not got - want


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=12), st.lists(st.integers(0, 3), min_size=12, max_size=12))
def test_edit_distance(a, b):
    row = list(range(13))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    got = K.edit_distance(np.array([a], np.uint64), np.array([b], np.uint64))[0]
    assert got == min(row[-1], K.EDITS + 1)


def test_equal_windows_have_equal_keys_and_near_ones_often():
    rng = np.random.default_rng(2)
    w = rng.integers(0, 1 << 60, (500, K.WINDOW)).astype(np.uint64)
    v = w.copy()
    v[np.arange(500), rng.integers(0, K.WINDOW, 500)] += np.uint64(1)
    at = np.arange(500) * K.WINDOW
    same = np.zeros(500, bool)
    for r in range(K.REPEATS):
        a, b = K.embed(w.ravel(), at, r), K.embed(v.ravel(), at, r)
        assert (a == K.embed(w.ravel(), at, r)).all()
        same |= a == b
    assert same.mean() > 0.9


def frame(spark, items):
    return spark.createDataFrame(items, "item_id string, text string")


def test_blocks_and_frame(spark, monkeypatch):
    q = ITEMS[3][1].split(".")[0]
    df = spark.createDataFrame([(1, q, "x"), (2, None, "x"), (3, "", "x"), (1, q, "x"), (4, "pad " * 50_000 + q, "x")], "doc_id long, text string, item_id string")
    want = [(1, "i3"), (4, "i3")]
    items = frame(spark, ITEMS)
    assert K.shared_wording(items) == SHARED
    assert sorted(map(tuple, K.leaks(df, items).collect())) == want
    monkeypatch.setattr(K, "BLOCK_WINDOWS", 200)
    assert len(list(K.blocks(items))) > 3
    assert sorted(map(tuple, K.leaks(df, items).collect())) == want
    assert K.leaks(df, items.limit(0)).count() == 0 and K.leaks(df.limit(0), items).count() == 0
    assert K.leaks(df, frame(spark, [(None, q), ("n", None), ("e", "")])).count() == 0


def test_a_question_of_many_items_leaks_for_all(spark):
    """Copies, and variants by one word, of a question; only wording that a third of the items put beside other text is shared."""
    q = ITEMS[3][1].split(".")[0].split()[:18]
    for copies in (3, 10, 100):
        same = [(f"c{k}", " ".join(q) + ".") for k in range(copies)]
        other = [("v", " ".join([*q[:9], "changed", *q[10:]]) + ".")]
        df = spark.createDataFrame([(1, "pad " * 30 + " ".join(q) + " pad" * 30)], "doc_id long, text string")
        got = {i for _, i in K.leaks(df, frame(spark, same + other)).collect()}
        assert got == {i for i, _ in same + other}


def test_a_bucket_taken_in_pieces(monkeypatch):
    q = ITEMS[3][1].split(".")[0]
    texts = [q] * 50
    want = K.search(texts, index())
    monkeypatch.setattr(K, "PAIRS", 7)
    assert K.search(texts, index()) == want and len(want) == 50


def test_recall_of_short_passages():
    """Passages of 14 words, which need both their outer windows, with 2 and 3 words exchanged."""
    rng = random.Random(31)
    idx = index()
    for edits in (2, 3):
        texts, want = [], set()
        for d in range(500 if edits == 2 else 2000):
            k, a = rng.randrange(60), rng.randrange(17)
            places = rng.sample(range(K.PASSAGE), edits)
            w = [f"other{x}" if i in places else x for i, x in enumerate(ITEMS[k][1].split(".")[0].split()[a : a + K.PASSAGE])]
            texts.append(" ".join(["pad"] * 9 + w + ["pad"] * 9))
            if all(sum(o <= p < o + K.WINDOW for p in places) <= K.EDITS for o in (0, K.PASSAGE - K.WINDOW)):
                want.add((d, f"i{k}"))
        assert len(want & set(K.search(texts, idx))) >= 0.99 * len(want) > 150
