import ast
import re

from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions import text as T
from millrace.operators import graph

SOURCE = '''import os
from a.b import c
from . import x

@deco
def outer(
    a: int = 1,
    b=(2, 3),
):
    """doc"""
    def inner():
        return 1

    return inner()


async def later():
    pass


class K:
    def outer(self):
        return 2
'''


def test_counts():
    assert C.function_count(SOURCE) == 4 and C.function_count("def f(:") == -1 and C.function_count(None) == 0 and C.function_count("") == 0
    assert C.function_count("x = 1\x00") == -1


def test_imports():
    assert C.imports(SOURCE) == ["os", "a.b"] and C.imports("def f(:") == [] and C.imports(None) == []


def test_extraction_and_masking():
    x = C.extracted(SOURCE, "outer")
    assert x["start_line"] == 5 and x["function_code"].startswith("def outer(") and "@deco" not in x["function_code"]
    assert "# <MASKED_FUNCTION_BODY>" in x["masked_code"] and '"""doc"""' not in x["masked_code"] and "class K:" in x["masked_code"]
    assert x["masked_code"].count("\n") == SOURCE.count("\n") - 5 + 1
    assert C.extracted(SOURCE, "none") is None and C.extracted(SOURCE, "later") is None and C.extracted(None, "f") is None
    broken = "def f(a):\n    return a\n\nx = (\n"
    assert C.extracted(broken, "f")["end_line"] == 3  # by indent, blank lines inside
    one = C.extracted("def f(): return 1\ny = 2\n", "f")
    assert "return 1" in one["masked_code"]
    ast.parse(x["masked_code"].replace("# <MASKED_FUNCTION_BODY>", "pass"))
    assert [f["name"] for f in C.every_function(SOURCE)] == ["outer", "inner"]


def test_functions_of_broken_files():
    broken = "class A:\n    def one_more(self):\n        return 0\n\n    def one(self, a=(1,\n            2)):\n        # note\n        if a:\n            return 1\n        return 2\n\n    def two(self): return 3\n\nx = (\n"
    one, two = C.extracted(broken, "one"), C.extracted(broken, "two")
    assert (one["start_line"], one["end_line"]) == (4, 11) and one["masked_code"].split("\n")[4:8] == ["    def one(self, a=(1,", "            2)):", "        # <MASKED_FUNCTION_BODY>", "    def two(self): return 3"]
    assert "return 3" in two["masked_code"] and two["start_line"] == 11
    assert C.extracted(broken, "on") is None and C.extracted("def f(", "f") is None


def test_masking_of_unlike_bodies():
    masked = lambda code, name="f": C.extracted(code, name)["masked_code"]
    assert masked("def f(\n  a,\n):\n\n    # why\n    @deco\n    def g(): pass\n    return g\ny = 1") == "def f(\n  a,\n):\n    # <MASKED_FUNCTION_BODY>\ny = 1"
    assert masked("def f(x: dict = {'a:': 1}) -> 'a:b':\n\treturn 1") == "def f(x: dict = {'a:': 1}) -> 'a:b':\n\t# <MASKED_FUNCTION_BODY>"


def test_objects():
    assert C.balanced_object('x {"a": "}{", "b": {"c": 1}} y') == '{"a": "}{", "b": {"c": 1}}' and C.balanced_object("{") is None
    assert C.response_object('```json\n{"a": 1}\n```') == '{"a": 1}' and C.response_object("say {\"a\": 2}") == '{"a": 2}' and C.response_object(None) is None


def files(spark):
    rows = [("r", "pkg/a.py", "import pkg.b\nimport pkg.c\nimport numpy.linalg"), ("r", "pkg/b.py", "import pkg.d\nimport pkg.d"), ("r", "pkg/c.py", "import pkg.d\nimport pkg.a"), ("r", "pkg/d.py", "import os"), ("r", "ossify.py", ""), ("q", "solo.py", "import solo")]
    return spark.createDataFrame(rows, "repo_id string, path string, code string").withColumn("module", F.lit("clash"))


def test_edges(spark):
    mods = graph.modules(files(spark).drop("module"), "repo_id", "path", "code")
    dotted = {(r.src, r.dst) for r in graph.edges(mods, "dotted").where("repo = 'r'").collect()}
    assert dotted >= {("pkg.a", "pkg.b"), ("pkg.a", "pkg.c"), ("pkg.b", "pkg.d"), ("pkg.c", "pkg.a")} and not [x for x in dotted if x[1] == "ossify"]
    prefix = {(r.src, r.dst) for r in graph.edges(mods, "prefix").collect()}
    assert ("pkg.d", "ossify") in prefix and ("solo", "solo") not in prefix
    assert {(r.src, r.package) for r in graph.external(mods, "dotted").collect()} == {("pkg.a", "numpy"), ("pkg.d", "os")}


def test_closure_order_level(spark):
    mods = graph.modules(files(spark), "repo_id", "path", "code")
    links = graph.edges(mods, "dotted")
    out = graph.ordered(graph.closure(mods, links), links)
    d = {r.module: r for r in out.where("repo = 'r' and root = 'pkg.b'").collect()}
    assert set(d) == {"pkg.b", "pkg.d"} and d["pkg.d"].level == 0 and d["pkg.b"].level == 1 and d["pkg.d"].pos == 0
    cycle = {r.module for r in out.where("root = 'pkg.a'").collect()}
    assert cycle == {"pkg.a", "pkg.b", "pkg.c", "pkg.d"}
    text = graph.rendered(out, mods.select("repo", "module", F.lit("code").alias("content"))).where("root = 'pkg.b'").first().text
    assert "★ pkg.b" in text and text.index("module: pkg.d") < text.index("module: pkg.b")
    assert graph.closure(mods.limit(0), links).count() == 0


def test_text(spark):
    def x(column, value):
        return spark.createDataFrame([(value,)], "s string").select(column.alias("x")).first().x

    for s in ("", "a", "a\n", "\n", "a\r\nb", "a\x0cb\u2028c", "a\x1cb\x85", "a\n\n", None):
        assert x(T.line_count("s"), s) == (None if s is None else len(s.splitlines()))
    assert x(T.repo_name("s"), "https://h/o/n.git") == "n.git" and x(T.repo_name("s"), "https://h/o") is None and x(T.repo_name("s"), None) is None
    assert x(T.repo_base("s"), "h/text.git") == "text" and x(T.repo_base("s", exact=False), "h/text.git") == "tex"
    assert x(T.owner_name("s"), "https://h/o/n.x.git") == "o-n_x"
    assert x(T.suffixes("s"), "a.b.c") == ["a.b.c", "b.c", "c"] and x(T.package("s"), "a.b") == "a"
    assert x(T.middle_cut("s", 4, "~"), "abcdef") == "ab~ef" and x(T.capitalised("s"), "hELLO wORLD") == "Hello world"
    assert x(T.tidied("s"), " a [title] b  [x]c ") == "a.  b c".replace(".  b", ". b")
    assert x(T.answer_part("s", ["</s>"]), "q<|im_start|>assistant hi</s>x") == "hi"
    assert x(T.module_name("s"), "/a/b.py") == "a.b"
    assert x(T.repeated_mark("s", "<image>", "P", F.array(F.lit(2), F.lit(1))), "x<image>y<image>z<image>") == "xPPyPz<image>"


def test_tidied_of_any_text(spark, tmp_path):
    from millrace.plans import catalogue

    def brute(t):
        return re.sub(r"\[.*?\]", "", t.strip().replace(" [title]", ". ")).replace("  ", " ")

    texts = ["\u3000é [title] 漢字 [x\r\ny] [a\rb]c\u2028", "\x1c\t[a\u2028b]x  y[c\x85d] \r\n", "a [b\nc] d]\u200b ", "😀 [[x]] [] \ufeff", "", " \xa0", "plain [title][z] x", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.tidy for r in catalogue.queries()["tidied_titles"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else brute(t) for i, t in enumerate(texts)}
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.text and brute(r.text) for r in whole.collect()}
    assert {r.doc_id: r.tidy for r in catalogue.queries()["tidied_titles"](spark, "/root/testdata/sf0.001").collect()} == want
