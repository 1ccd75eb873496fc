import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pairs as Q
from millrace.llm import records
from millrace.llm import truncation as T
from millrace.session import written

BODY = "The narrow window filters every batch before the mask is applied, and the parser reports the hidden metric after each pass of the outer loop. "


@pytest.mark.parametrize(
    "text,form",
    [("It ends.", "end"), ("It ends.”", "end"), ("结束了。", "end"), ("the parser repo", "word"), ("so \\boxed{4", "open"), ("\\boxed{42}", "answer"), ("```\n42\n```", "answer"), ("```\n42", "open"), ("#### 17", "answer"), ("Answer: 17", "answer"), ("17", "answer"), ("", "blank"), (None, "blank"), ("<think>\n\n</think>", "blank"), ("​", "blank"), ("\\boxed{}", "blank"), ("```\n```", "blank"), ("We compute 3 * 4, which is 1", "word")],
)
def test_endings(text, form):
    assert T.closing(text)[0] == form


def test_alignment():
    full = BODY + "So the arithmetic is 302 * 2 = 604. Answer: 604"
    assert T.ends_early(full[:-20], full) and T.ends_early(full[:-1], full)  # inside a word, inside a number
    assert not T.ends_early(BODY.strip(), full)  # at a sentence's end
    assert not T.ends_early(full, full) and not T.ends_early("", full) and not T.ends_early("Another text that is not alike.", full)
    long = " ".join(f"Sentence {i} tells of the {BODY.split()[i]} and of part {i * 7}." for i in range(20)) + " It ends with the reconstruction of everything."
    typo = long.replace("Sentence 3", "Sentense 3")
    assert T.ends_early(typo[:-22], long) and not T.ends_early(typo, long) and not T.ends_early(typo[:-47], long)


def test_bands_meet_near_copies():
    texts = [BODY * 2 + f"tail {i} of the text stands here" for i in range(40)] + ["word " * 3, "", "好的" * 30]
    keys = T.bands(texts)
    assert all(set(keys[0]) & set(k) for k in keys[1:40]) and keys[40] == [] and keys[41] == [] and len(keys[42]) == T.BANDS * len(T.levels(60))
    assert T.bands(texts[3:4])[0] == keys[3]


@pytest.mark.parametrize("kept", [0.1, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9, 0.98])
@pytest.mark.parametrize("exchanged", [0.0, 0.02])
def test_cut_copies_meet_their_whole(kept, exchanged):
    """Recall of the candidates by the share that is kept of a text of 120 words, some of them exchanged."""
    rng = random.Random(int(kept * 100))
    made = lambda n: [f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.randrange(400)}" for _ in range(n)]
    wholes = [made(120) for _ in range(200)]
    cuts = [" ".join(w if rng.random() >= exchanged else "other" for w in x[: int(120 * kept)]) for x in wholes]
    keys = T.bands([" ".join(x) for x in wholes] + cuts)
    top = T.LOOKED * T.BANDS
    met = sum(bool(set(keys[i]) & set(keys[200 + i][-top:])) for i in range(200))
    assert met >= (1.0 if not exchanged else 0.9 if kept >= 0.3 else 0.85) * 200  # twelve words have two levels only
    assert not any(set(keys[i]) & set(keys[200 + (i + 1) % 200][-top:]) for i in range(200))


def test_deep_cuts_are_found(spark):
    rng = random.Random(4)
    made = lambda n: " ".join(f"w{rng.randrange(900)}x" for _ in range(n))
    rows, want = [], set()
    for i in range(60):
        whole = f"{made(90)} the end of it."
        rows.append((2 * i, whole))
        cut = whole[: int(len(whole) * (0.2 + 0.01 * i))].rstrip() if i % 3 else whole
        rows.append((2 * i + 1, cut))
        want |= {2 * i + 1} if i % 3 else set()
    d = spark.createDataFrame([(k, t, hashlib.md5(t.encode()).digest(), T.closing(t)[0], T.bands([t])[0]) for k, t in rows], "k long, text string, text_key binary, form string, keys array<long>")
    got = {r.k for r in d.join(T.aligned_early(d), "text_key", "left_semi").collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def frames(spark):
    full = BODY + "So the arithmetic is 302 * 2 = 604. Answer: 604"
    texts = {1: full, 2: full[:-1], 3: full[:70], 4: "", 5: None, 6: "la " * 40, 7: "It is whole.", 8: full, 9: "\\boxed{4"}
    vocab = sorted({c for t in texts.values() if t for c in t})
    v = spark.createDataFrame([(0, "<pad>", True), *((i + 1, c, False) for i, c in enumerate(vocab))], "token_id long, piece string, is_special boolean")
    ids = {c: i + 1 for i, c in enumerate(vocab)}
    rows = []
    for k, t in texts.items():
        if t is None:
            rows.append((k, None, None, [0] * 4, [0, 0, 1, 1], "clash"))
        else:
            e = [ids[c] for c in t]
            rows.append((k, "S" if k % 2 else "s", e + [0] * 3, [0] * 4, [0, 0, 1, 1] + [1] * len(e) + [0] * 3, "clash"))
    rows.append(rows[0])
    return spark.createDataFrame(rows, "row_idx long, data_source string, responses array<long>, prompts array<long>, attention_mask array<int>, response string"), v


def test_visible_texts(spark):
    r, v = frames(spark)
    got = {x.row_idx: x.response for x in records.visible_texts(r, v, prompts=True).collect()}
    assert got[7] == "It is whole." and got[4] == "" and got[5] is None


def test_cut_records(spark):
    r, v = frames(spark)
    out = {x.record_id: x.cut for x in T.cut_records(written(T.measured(r, v, None), "t")).collect()}
    assert out == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False, 8: False, 9: True}
    assert T.cut_records(written(T.measured(r.limit(0), v, None), "t")).count() == 0


def test_endless_at_the_limit(spark):
    loop = ("The cache is cold and the queue fills. " * 6).strip()
    v = spark.createDataFrame([(i, loop[i : i + 1] or "x", False) for i in range(len(loop))], "token_id long, piece string, is_special boolean")
    ids = list(range(len(loop)))
    df = spark.createDataFrame([(1, "a", ids, [1] * len(ids), [0]), (2, "a", ids[:-39], [1] * (len(ids) - 39), [0]), (3, "b", ids, [1] * len(ids), [0])], "row_idx long, data_source string, responses array<long>, attention_mask array<int>, prompts array<long>")
    out = {x.record_id: x.cut for x in T.cut_records(written(T.measured(df, v, None), "t")).collect()}
    assert out == {1: True, 2: False, 3: True}


@settings(deadline=None, max_examples=100)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_words(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert Q.common_words(a, b) == table[-1][-1]


PROMPT = "How many rows are there in total when 7 shards hold 374 rows each?"


@pytest.mark.parametrize(
    "prompt,response,want",
    [
        (PROMPT, None, ["empty"]), (PROMPT, " \n​", ["empty"]), (PROMPT, "\\boxed{}", ["empty"]), (PROMPT, "  HOW MANY rows are there in total when 7 shards hold 374 rows each ...\n", ["copy"]), (PROMPT, PROMPT + "\n\nWe compute 7 * 374, which is 2618.", []), ("求778与8的和。", "求778与8的和。", ["copy"]),
        (PROMPT, "I'm sorry, but I can't help with that.", ["refusal"]), (PROMPT, "Unfortunately the first guess was wrong, so we repeat it. Answer: 2618", []), (PROMPT, "The verifier must decline any empty box, but ours is filled. Answer: 5", []), (PROMPT, "Desafortunadamente, no puedo ayudar con esto.", ["refusal"]), ("求778与8的和。", "很遗憾，我无法回答这个问题。", ["refusal"]), (PROMPT, "Leider muss ich ablehnen.", ["refusal"]), (PROMPT, PROMPT + " You will have to look elsewhere for that.", ["refusal"]),
        (PROMPT, "Die Summe der Zeilen ist nicht schwer, denn es sind sieben Teile. \\boxed{2618}", ["wrong_language"]), (PROMPT + " Please reply in German.", "Die Summe der Zeilen ist nicht schwer. \\boxed{2618}", []), (PROMPT + " Please reply in German.", "There are many rows in the shards and we count them.", ["wrong_language"]), (PROMPT, "\\boxed{2618}", []), ("求778与8的和。", "由778 + 8可得786。", []), (None, "Hello there.", []), (PROMPT, "2618", []),
    ],
)
def test_defects(prompt, response, want):
    assert Q.defects(prompt, response) == want


def test_judged_pair(spark):
    m = lambda r, c: (r, c)
    rows = [(1, [m("system", "s"), m("user", "ex"), m("assistant", "exa"), m("user", "q"), m("assistant", "a")]), (2, [m("user", "q")]), (3, None), (4, [m("assistant", "a")]), (5, [m("user", "q"), m("assistant", None)]), (6, [])]
    df = spark.createDataFrame(rows, "result_id long, convo array<struct<role:string,content:string>>")
    got = {r.result_id: (r.prompt, r.response) for r in records.judged_pairs(df).collect()}
    assert got == {1: ("q", "a"), 2: ("q", None), 3: (None, None), 4: (None, None), 5: ("q", None), 6: (None, None)}


@pytest.mark.parametrize("text", ["Sorry, but this is one I have to turn down.", "I am afraid I cannot take part in that.", "We are not in a position to answer, so I will pass on this one.", "Leider kann ich Ihnen bei dieser Frage nicht weiterhelfen.", "Je ne peux malheureusement pas vous aider.", "Lo siento, no puedo ayudarte con eso.", "很抱歉，我没有办法回答。", "This is beyond what I am allowed to say."])
def test_refusals_in_other_words(text):
    assert Q.is_refusal(text) and not Q.is_refusal(text + " Answer: 42")


@pytest.mark.parametrize("text", ["I cannot see the second number, but the first is 4.", "We must need two steps for this.", "Ich kann das Ergebnis nicht sofort ablesen.", "The parser cannot answer before the batch is done.", "No answer is given by the first line alone, so read on. #### 55"])
def test_no_refusals(text):
    assert not Q.is_refusal(text)


@pytest.mark.parametrize(
    "text,language",
    [("Сумма двух чисел равна двенадцати, и это всё.", "ru"), ("この問題の答えは十二です。", "ja"), ("이 문제의 답은 열둘입니다.", "ko"), ("Il risultato della somma è dodici perché ogni numero viene contato.", "it"), ("Não há nenhum número que fique de fora, então a soma é doze.", "pt"), ("Het resultaat is twaalf omdat elk getal een keer telt.", "nl"), ("مجموع العددين هو اثنا عشر.", "ar"), ("这个问题的答案是十二。", "zh")],
)
def test_languages(text, language):
    found = Q.languages(text)
    assert max(found, key=found.get) == language
    assert Q.wrong_language("What is the sum of the two numbers that we found in the last step?", text)
    assert Q.wrong_language("请回答这个问题：两个数的和是多少？", text) == (language != "zh")


def test_the_character_model_on_held_out_sentences():
    held = {"en": "children playing outside until evening", "de": "kinder spielten draußen lange abends weiter", "fr": "enfants jouaient dehors jusqu'au soir tombé", "es": "niños jugaban fuera hasta anochecer tranquilamente", "it": "bambini giocavano fuori fino alla sera tardi", "nl": "kinderen speelden buiten totdat avond werd"}
    got = {k: Q.likely_language(v.split()) for k, v in held.items()}
    assert all(v in (k, None) for k, v in got.items()) and sum(v is not None for v in got.values()) >= 4


def texts_of(spark, texts):
    rows = [(t, hashlib.md5(t.encode()).digest(), T.closing(t)[0], T.bands([t])[0]) for t in texts]
    return spark.createDataFrame(rows, "text string, text_key binary, form string, keys array<long>")


def met_outright(texts):
    """The texts that end early in any text whose bands they look at, by comparing all with all."""
    keys = T.bands(texts)
    looks = [set(k[-T.LOOKED * T.BANDS :]) if T.closing(t)[0] not in ("end", "blank") else set() for t, k in zip(texts, keys)]
    return {a for a, x in zip(texts, looks) for b, y in zip(texts, keys) if a != b and x & set(y) and T.ends_early(a, b)}


HEAD = "the narrow window filters every batch before the mask is applied here Answer: "


@pytest.mark.parametrize("others", [1, T.DIRECT + 20])
def test_a_whole_that_is_not_the_longest_of_its_bands(spark, others):
    """Longer texts that share the beginning stand between a cut copy and its whole, in a small band and in a large one."""
    longer = [f"{HEAD}{7000 + i} and {'the queue is drained again ' * (2 + i % 3)}until {i}." for i in range(others)]
    texts = [HEAD + "60", HEAD + "604 is what remains.", *longer]
    got = {r.text for r in texts_of(spark, texts).join(T.aligned_early(texts_of(spark, texts)), "text_key", "left_semi").collect()}
    assert got == met_outright(texts) == {HEAD + "60"}


@pytest.mark.parametrize("direct", [1, 6, 1000])
def test_every_longer_text_of_a_band_is_met(spark, monkeypatch, direct):
    monkeypatch.setattr(T, "DIRECT", direct)
    rng = random.Random(8)
    words = ["alpha", "beta", "Gamma", "delta", "omega", "the", "of", "ΟΔΟΣ", "İzmir", "求", "数", "x1", "42"]
    made = lambda n: [rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n)]
    heads = [made(8), made(14), made(26)]
    wholes = [head + made(rng.randrange(2, 40)) for head in heads for _ in range(45)]
    texts = [" ".join(w) for w in wholes]
    for w in wholes:
        cut = w[: rng.randrange(8, len(w) + 1)]
        cut = [rng.choice(words) if rng.random() < 0.04 else x for x in cut]
        text = " ".join(cut)
        texts.append(text[: len(text) - rng.randrange(0, 4)] + rng.choice(["", "", " ", "\n\t", " ", "!"]))
    texts = sorted(set(texts))
    want = met_outright(texts)
    d = texts_of(spark, texts)
    got = {r.text for r in d.join(T.aligned_early(d), "text_key", "left_semi").collect()}
    assert got == want and len(want) > 50


def test_texts_that_may_end_early():
    rng = random.Random(2)
    base = [f"w{rng.randrange(40)}" for _ in range(60)]
    made = [" ".join(x if rng.random() > 0.05 else "other" for x in base[: rng.randrange(1, 60)]) for _ in range(60)] + ["", " ", "la la la la la la"]
    pairs = [(a, b) for a in made for b in made]
    may = T.may_end_early([a for a, _ in pairs], [b for _, b in pairs])
    assert all(m for m, (a, b) in zip(may, pairs) if T.ends_early(a, b)) and 0 < sum(may) < len(pairs)


def test_cut_pairs_of_both_tables_meet_their_whole(spark, tmp_path):
    """The cut copy ends like an answer, so only its whole, which is not the longest of its bands, shows that it is cut."""
    texts = [HEAD + "60", HEAD + "604 is what remains.", f"{HEAD}7000 and the queue is drained again until 1."]
    vocab = sorted(set("".join(texts)))
    ids = {c: i + 1 for i, c in enumerate(vocab)}
    spark.createDataFrame([(0, "<pad>", True), *((i, c, False) for c, i in ids.items())], "token_id long, piece string, is_special boolean").write.parquet(f"{tmp_path}/vocab.parquet")
    rows = [(k, "s", [ids[c] for c in t], [0] * 4, [0] * 4 + [1] * len(t), "clash") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "row_idx long, data_source string, responses array<long>, prompts array<long>, attention_mask array<int>, response string").write.parquet(f"{tmp_path}/rollout.parquet")
    chats = [(10 + k, [("user", "How many rows remain?"), ("assistant", t)]) for k, t in enumerate(texts)]
    spark.createDataFrame(chats, "result_id long, convo array<struct<role:string,content:string>>").write.parquet(f"{tmp_path}/eval_results.parquet")
    assert {(r.src, r.record_id, r.defect) for r in Q.p5_found(spark, str(tmp_path)).collect()} == {("rollout", 0, "truncated"), ("eval_results", 10, "truncated")}
    assert [r.row_idx for r in T.p4_found(spark, str(tmp_path)).collect()] == [0]


def test_the_last_word_is_read_from_the_end():
    """A long word that a figure follows took time by its square."""
    text = "a" * 30_000 + "1"
    began = time.process_time()
    assert T.closing(text) == ("word", "") and T.closing(text[:-1] + " -") == ("word", text[:-1])
    assert time.process_time() - began < 1


def test_only_counted_records_are_looked_at_for_endless_repetition(spark):
    """The evaluations have no token counts, so no limit that an endless text could be at: the trees don't read them."""
    r, v = frames(spark)
    loop = "la " * 40
    e = spark.createDataFrame([(1, [("user", "q"), ("assistant", loop)])], "result_id long, convo array<struct<role:string,content:string>>")
    loops = {(x.src, x.record_id): x.loops for x in T.measured(r, v, e).collect()}
    assert loops["rollout", 6] >= T.ENDLESS and loops["eval_results", 1] == 0


PIECES = ["####", "###", " ", "\n", "```", "`", "\\boxed{", "\\BOXED{", "{", "}", "}$", "=", "= 4", "3 * 4 =", "×", "answer", "Answer:", "anſwer: 5", "Ergebnis ist", "RÉSULTAT est 3", "resultado es", "答案", "：", ":", "is", "İs", "17", "</b>", "</", ">", "\x1c", "\xa0", "求", "Σ", "é", "I", "word", "abc1", "."]


@settings(deadline=None, max_examples=400)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_quick_ways_say_what_the_patterns_say(text):
    assert Q.gives_result(text) == bool(Q._RESULT.search(text))
    t = text.rstrip()
    assert not t or T._answers(t) == bool(T._ANSWER.search(t))
    last = re.search(r"([^\W\d_]+)\W*$", t)
    if T.closing(t)[0] == "word":
        word = last[1].lower() if last else ""
        assert T.closing(t)[1] == (word[-1:] if word and ord(word[-1]) > 0x2E80 else word)
    words: dict[str, list[int]] = {}
    for w, close in re.findall(r"([^\W\d_]+)([ \t]*\r?\n(?=\s*\S))?", text.lower()):
        c = words.setdefault(w[-1] if ord(w[-1]) > 0x2E80 else w, [0, 0])
        c[0] += 1
        c[1] += close != ""
    assert T.closing_counts([text]) == words
