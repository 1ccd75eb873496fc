import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.operators import scoring as S


@pytest.mark.parametrize(
    "text,want",
    [("no box", None), ("\\boxed{}", ""), ("\\boxed{1} and \\boxed{a{b{c}}}", "a{b{c}}"), ("\\boxed{a{b{c{d}}}}", None), (None, None), ("x" * 200_000 + "\\boxed{7}", "7")],
)
def test_last_box(text, want):
    assert A.last_box(text) == want


def test_statements():
    assert A.last_statement("Answer: 3\nThe answer is: 4\nrest") == "4"
    assert A.last_statement("Final Answer: 9<|im_end|>\n") == "9"
    assert A.last_statement("Answer: 9") is None and A.last_statement(None) is None
    assert A.final_answer("\\boxed{}\nAnswer: 5\n") == "5" and A.final_answer("\\boxed{6}\nAnswer: 5\n") == "6"


def test_boxes_by_counting():
    assert A.last_boxed_part("\\boxed{a{b{c{d}}}} x") == "\\boxed{a{b{c{d}}}}"
    assert A.last_boxed_part("\\fbox{3}") == "\\fbox{3}" and A.last_boxed_part("\\fbox{3}", fbox=False) is None
    assert A.last_boxed_part("$\\boxed 5$") == "\\boxed 5" and A.unboxed("\\boxed 5") == "5"
    assert A.unboxed("\\boxed{a{b}}") == "a{b}" and A.unboxed(None) is None and A.last_boxed_part("\\boxed{3") is None


@pytest.mark.parametrize("a,b", [("\\frac12", "\\dfrac{1}{2}"), ("0.5", "\\frac{1}{2}"), ("1/2", "\\frac{1}{2}"), ("\\sqrt3", "\\sqrt{3}"), ("12\\text{ cm}", "12"), (".5", "0.5"), ("x=4", "4"), ("\\$5", "5"), ("5\\%", "5"), ("7.00", "7"), ("1,234", "1234")])
def test_equivalent(a, b):
    assert A.equivalent(a, b)


def test_not_equivalent():
    assert not A.equivalent("1", "2") and not A.equivalent(None, "1") and A.equivalent(None, None)


@pytest.mark.parametrize(
    "given,truth,right",
    [("\\frac{1}{2}", "0.5", True), ("2/4", "1/2", False), ("(1, 2)", "(1,2)", True), ("(1, 2)", "[1,2]", False), ("2*3", "6", False), ("5 million", "5000000", True), ("\\sqrt{4}+x", "6", False), ("1,000", "1000", True), (None, "1", False), ("", "1", False)],
)
def test_graded(given, truth, right):
    assert A.graded(given, truth) is right


def test_math_equal():
    assert A.math_equal("50", "0.5") and not A.math_equal("50", "0.5", percent=False)
    assert A.math_equal("(1, 2.0)", "(1,2)") and A.math_equal("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix} 1 & 2 \\\\ 3 & 4.0 \\end{pmatrix}")
    assert A.math_equal("\\frac{1}{3}", "0.33333333") and not A.math_equal("x", None)


def test_expressions_are_parsed_not_run():
    assert A.evaluated("2*(3+4)**2/7") == 14 and abs(A.evaluated("sqrt(2)*pi") - math.sqrt(2) * math.pi) < 1e-12
    assert A.evaluated("__import__('os')") is None and A.evaluated("9**9**9") is None and A.evaluated("1/0") is None and A.evaluated("(1") is None


@pytest.mark.parametrize("s,want", [("1,234", 1234), (" 5% ", 0.05), ("3/4", 0.75), ("1_000", 1000), ("1.0d", None), ("inf", None), ("", None), (None, None)])
def test_numbers(s, want):
    assert A.as_number(s) == want


def test_program_outputs():
    assert A.outputs_match("1 2\n", "1.0 2") and A.outputs_match("b a\nc", "a b\nc") and not A.outputs_match("1", "2") and not A.outputs_match(None, "1")


def test_intervals_and_bases():
    assert A.interval_text("Interval.open(1, 2)") == "(1, 2)" and A.interval_text("Interval(1,2)") == "[1,2]" and A.in_base("1011_2") == "1011" and A.in_base("x_1 + 2") == "x_1 + 2"
    assert A.marked_answer("So the answer is 42. Done") == (True, "42") and A.marked_answer("none") == (False, "none") and A.marked_answer(None) == (False, "")


def test_columns(spark):
    rows = [("#### 1,234.", "x. 12 . 7", "Answer: $b$"), ("none", "...", "(A) or C"), (None, None, None), ("", "", "")]
    df = spark.createDataFrame(rows, "h string, n string, c string")
    got = df.select(A.hash_answer("h").alias("h"), A.last_number("n").alias("n"), A.choice_letter("c").alias("l"), A.contained_letter("c").alias("k")).collect()
    assert [tuple(r) for r in got] == [("1234.", "7", "b", "A"), (None, "...", None, "A"), (None, None, None, None), (None, None, None, None)]
    many = spark.createDataFrame([("答案：B",), ("Respuesta: c",), ("الإجابة: ب",)], "t string").select(A.multilingual_letter("t").alias("x")).collect()
    assert [r.x for r in many] == ["B", "C", "B"]


def test_minerva(spark):
    rows = [("x = 1,000 dollars", "1000"), ("$\\frac{1}{2}$", "\\frac{1}{2}"), ("\\frac12", "\\frac{1}{2}"), ("\\text{yes}", "yes"), ("45^\\circ", "45")]
    got = [r.x for r in spark.createDataFrame(rows, "t string, w string").select(A.minerva("t").alias("x")).collect()]
    assert got == [w for _, w in rows]


def test_loose(spark):
    rows = [("(a)", "a", True), ("1.0", "1", True), ("'x'", "x", True), ("[x]", "x", True), ("x?", "x", True), ("x", "y", False), (None, "x", False)]
    got = [r.x for r in spark.createDataFrame(rows, "a string, b string, w boolean").select(A.loosely_equal("a", "b").alias("x")).collect()]
    assert got == [w for *_, w in rows]


def test_scores(spark):
    df = spark.createDataFrame([("gsm", "#### 5", "5"), ("box", "\\boxed{1/2}", "\\frac{1}{2}"), ("dapo", "Answer: 6", "7"), ("mc", "Answer: B", "B")], "s string, r string, t string")
    rules = {"gsm": S.number_match, "box": S.box_match, "dapo": S.stated_match, "mc": S.letter_match}
    assert [r.x for r in df.select(S.dispatch(F.col("s"), F.col("r"), F.col("t"), rules).alias("x")).collect()] == [1.0, 1.0, -1.0, 1.0]
    with pytest.raises(Exception, match="no rule"):
        df.select(S.dispatch(F.col("s"), F.col("r"), F.col("t"), {"gsm": S.number_match}).alias("x")).collect()
    judge = spark.createDataFrame([(None, "Final Decision: Yes", 5, 5), ("s", "Final Decision: Yes", 5, 9), ("s", "Final Decision: Yes", 99, 5), ("s", "No", 1, 1)], "s string, j string, a int, b int")
    assert [round(r.x, 6) for r in judge.select(S.judged_reward(F.col("s"), F.col("j"), F.col("a"), F.col("b")).alias("x")).collect()] == [-0.5, 0.8, 0.5, 0.0]


def test_recorded_tests(spark):
    df = spark.createDataFrame([([True] * 3,), ([True] * 9 + [False, True],), ([],)], "p array<boolean>")
    assert [round(r.x, 6) for r in df.select(S.tests_match(F.col("p"), True).alias("x")).collect()] == [1.0, 0.9, 1.0]


def test_user_functions(spark, tmp_path):
    f = tmp_path / "rule.py"
    f.write_text("def length(text, factor=1):\n    if text == 'bad':\n        raise ValueError\n    return {'score': len(text) * factor}\n")
    r = S.Registry()
    r.from_file(str(f), "length", factor=2)
    r.batch("ones", lambda xs: [1 for _ in xs])
    df = spark.createDataFrame([("abc",), ("bad",)], "t string")
    fixed = r.rows["length"]
    assert fixed("abc") == {"score": 6}
    assert [x.o for x in df.select(r.column("ones", "t").alias("o")).collect()] == [1.0, 1.0]


def test_free_form_and_formats():
    assert A.free_form("So. The answer is: **Yes**.\nMore") == "**yes**.\nmore".split("\n")[0].replace("*", "").rstrip(".") or A.free_form("The answer is: (A).") == "(a)"
    assert A.free_form("The answer is: $\\text{B}$.") == "b" and A.free_form("X, Y", reference=True) == "x,y" and A.free_form(None) is None
    assert A.graded_with_format("so the answer is 2\\pi", "6.28")[0] and A.graded_with_format("nothing", "1") == (False, False, "nothing") and not A.graded_with_format(None, "1")[0]


def test_yes(spark):
    df = spark.createDataFrame([(" Yes",), ("no",), (None,)], "j string")
    assert [r.x for r in df.select(A.says_yes("j").alias("x")).collect()] == [True, False, False]
