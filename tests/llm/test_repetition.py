import numpy as np

from millrace.llm import boost
from millrace.llm import repetition as R

SENTENCES = ["The narrow window filters every batch before the mask is applied.", "Neither the ledger nor the parser reports the hidden metric.", "Between step 12 and step 40 the sampler doubles its kernel.", "In most runs the scheduler compresses the frozen tensor."]


def test_composed_records_held_out():
    rng = np.random.default_rng(99)
    made = [R._compose(rng, "wide" if i % 3 == 0 else "spaced") for i in range(400)]
    got, want = R.repeated_share([t for t, _ in made]), np.array([s for _, s in made])
    assert np.abs(got - want).mean() < 0.05
    clear = np.abs(want - R.THRESHOLD) > 0.08
    assert ((got >= R.THRESHOLD) == (want >= R.THRESHOLD))[clear].mean() > 0.98


def test_repeats_in_other_dress():
    s = SENTENCES[0]
    plain = " ".join(SENTENCES)
    dressed = " ".join([*SENTENCES[:1], s.upper(), s.replace(" ", "  "), "3. " + s.rstrip(".") + "!", SENTENCES[1]])
    low, high = R.repeated_share([plain, dressed])
    assert low < 0.2 and high > 0.5


def test_loops_and_scripts():
    texts = ["好的" * 60, "从第3步到第8步，采样器拆分了掩码。" * 6, "=-" * 80, "la " * 60, SENTENCES[0] + " " + "~" * 200, "从第3步到第8步，采样器拆分了掩码。如果没有窗口，序列就拒绝了索引。模型与梯度预热之后进行了比较。"]
    got = R.repeated_share(texts)
    assert (got[:5] >= R.THRESHOLD).all() and got[5] < R.THRESHOLD


def test_nothing_to_repeat():
    got = R.repeated_share(["", "x", "<think>\n\n</think>", "\\boxed{12}", "#### 7", " \n\t", "So the arithmetic is 1 + 2 = 3."])
    assert (got < R.THRESHOLD).all() and len(R.repeated_share([])) == 0


def test_more_repeats_never_score_less():
    x = np.zeros((1, len(R.FEATURES)))
    forest = R.model()
    for j in np.flatnonzero(R.MONOTONE):
        steps = np.repeat(x, 21, 0)
        steps[:, j] = np.linspace(0, 1, 21)
        assert (np.diff(forest.score(steps)) >= -1e-12).all()


def test_scores_don_t_depend_on_the_batch():
    texts = [*SENTENCES, "好的" * 60, " ".join([SENTENCES[0]] * 4)]
    assert np.allclose(R.repeated_share(texts), [R.repeated_share([t])[0] for t in texts])


def test_boosting_fits_and_keeps_order():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = x[:, 0] ** 2 + 0.3 * np.sin(9 * x[:, 1]) + 0.05 * rng.normal(size=2000)
    f = boost.fit(x, y, np.array([1, 0, 0]))
    assert np.abs(f.score(x) - y).mean() < 0.08
    line = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.4), np.full(50, 0.5)])
    assert (np.diff(f.score(line)) >= -1e-12).all()


def test_frame(spark):
    df = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, " ".join([SENTENCES[0]] * 5), 0.1), (3, " ".join([SENTENCES[0]] * 5), 0.1)], "id long, response string, share double")
    rows = R.measure(df, ["id"]).collect()
    assert len(rows) == 4 and rows[0].share < 0.4 and rows[1].share < 0.4 and rows[2].share == rows[3].share > 0.6
    assert R.measure(df.limit(0), ["id"]).count() == 0


def test_loops_within_a_word():
    texts = ["3" * 160, "ha" * 80, SENTENCES[0] + " " + "0" * 140, SENTENCES[0] + " " + "ha" * 200, " ".join(SENTENCES) + " " + "q8" * 12, "".join(np.random.default_rng(1).choice(list("abcdefghijklmnop0123"), 200))]
    got = R.repeated_share(texts)
    assert (got[:4] >= R.THRESHOLD).all() and (got[4:] < R.THRESHOLD).all()


def test_runs_within_repeated_runs_are_all_runs():
    """Runs are looked for only where shorter ones repeat; the shares are those of all runs."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["s", "tt", "uuu", "v"]) for _ in range(rng.integers(0, 90))) for _ in range(60)] + ["", "a b", " ".join("abcdefghijklmnopqrstuvwxyz" * 2)]
    got = R.statistics(texts)
    for row, text in zip(got, texts):
        words = text.split()
        for j, k in enumerate(R.RUNS):
            seen, inside = set(), set()
            for i in range(len(words) - k + 1):
                run = tuple(words[i : i + k])
                inside |= set(range(i, i + k)) if run in seen else set()
                seen.add(run)
            weight = sum(len(words[i]) for i in inside) / max(sum(map(len, words)), 1)
            assert abs(row[j] - weight) < 1e-9
