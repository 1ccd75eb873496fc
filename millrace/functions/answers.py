"""Final answers: finding them in responses, normalising and comparing them.

What SQL says exactly is a column function. What needs nested braces or ordered rewriting is plain Python, wrapped in
Arrow UDFs; every function takes null and gives null (or False where it compares).
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import algebra

#: Fixed value: the last box, two levels of braces deep.
_BOX = re.compile(r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}")


def last_box(text: str | None) -> str | None:
    """Content of the last \\boxed{...} with at most two levels of braces inside."""
    found = _BOX.findall(text or "")
    return found[-1] if found else None


#: Phrasings that lead a final answer, any case, and the marks at which a model stops.
LEADS = ["Final Answer:", "Final Answer is:", "The answer is:", "Answer:", "Solution:", "The solution is:"]
STOPS = ["</s>", "<|im_end|>", "<|endoftext|>"]
_LEAD = re.compile("(?=(?:" + "|".join(map(re.escape, LEADS)) + r")\s*((?:[^<\n]|<(?!<))*)\n)", re.I)


def last_statement(text: str | None) -> str | None:
    """What follows, on one ended line, the lead that begins last; stop marks at its end go."""
    found = _LEAD.findall(text or "")
    if not found:
        return None
    out = found[-1].strip()
    for stop in STOPS:
        out = out.removesuffix(stop).strip()
    return out


def final_answer(text: str | None) -> str | None:
    """The last box, else the last statement; an empty box doesn't count."""
    return last_box(text) or last_statement(text)


def last_boxed_part(text: str | None, fbox: bool = True) -> str | None:
    """The last '\\boxed{...}' by counting braces, any depth, command included; '\\boxed x$' ends at the dollar; \\fbox
    counts where there is no \\boxed and `fbox` is set."""
    if not text:
        return None
    at = text.rfind("\\boxed")
    spaced = re.search(r"\\boxed ([^$]*)", text[at:]) if at >= 0 and text[at : at + 7] == "\\boxed " else None
    if spaced:
        return "\\boxed " + spaced[1]
    if at < 0:
        at = text.rfind("\\fbox") if fbox else -1
        if at < 0:
            return None
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if text[i] == "}" and depth == 0:
            return text[at : i + 1]
    return None


def unboxed(part: str | None) -> str | None:
    """The content of what last_boxed_part gives."""
    if part is None:
        return None
    if part.startswith("\\boxed "):
        return part[7:]
    m = re.fullmatch(r"\\f?boxe?d?\{(.*)\}", part, re.S)
    return m[1] if m else None


def as_number(s: str | None) -> float | None:
    """Number of a plain text: thousands commas, one percent sign, fractions a/b and underscores within digits count."""
    if s is None:
        return None
    t = s.strip().replace("{,}", ",").replace("\\%", "%").strip("$ ")
    scale = 1.0
    if t.endswith("%"):
        t, scale = t[:-1], 0.01
    if re.fullmatch(r"[-+]?\d{1,3}(,\d{3})+(\.\d*)?", t):
        t = t.replace(",", "")
    m = re.fullmatch(r"([-+]?\d+)\s*/\s*(\d+)", t)
    if m and int(m[2]):
        return scale * int(m[1]) / int(m[2])
    if re.fullmatch(r"[-+]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][-+]?\d+)?", t):
        return scale * float(t.replace("_", ""))
    return None


#: Units and words that are dropped behind a number.
UNITS = ["degrees", "degree", "units", "unit", "cm", "mm", "km", "meters", "metres", "meter", "inches", "inch", "feet", "foot", "miles", "hours", "hour", "minutes", "minute", "seconds", "second", "dollars", "dollar", "cents", "cent", "points", "point", "square", "cubic", "years", "year", "days", "day"]
_UNIT = re.compile(r"(?<=[\d}\s])\s*\\?(?:text|mbox|mathrm)?\{?\s*(?:" + "|".join(UNITS) + r")\b[^\d]*$", re.I)


def normalised(s: str | None) -> str | None:
    """One spelling for answers in mathematical notation: spaces, sizing commands, units, dollar and percent signs go;
    fractions, roots and simple quotients get braces; a leading zero is added, a trailing '.0' dropped."""
    if s is None:
        return None
    t = s.replace("\n", "").replace("\\!", "").replace("\\\\", "\\").replace("\u2212", "-")
    for old, new in (("tfrac", "frac"), ("dfrac", "frac"), ("cfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("$", ""), ("\\%", ""), ("%", ""), ("\\,", ""), ("\\;", ""), ("\\ ", "")):
        t = t.replace(old, new)
    t = _UNIT.sub("", t)
    t = re.sub(r"\\text\s*\{\s*([^{}]*?)\s*\}$", lambda m: m[1] if not t[: m.start()].strip() else "", t)
    t = re.sub(r"^[a-zA-Z]\s*=\s*", "", t.strip())
    t = re.sub(r"\\sqrt\s*([^\s{\\])", r"\\sqrt{\1}", t).replace(" ", "")
    t = re.sub(r"\\frac([^{\\])([^{\\])", r"\\frac{\1}{\2}", t)
    t = re.sub(r"\\frac\{([^{}]*)\}([^{\\])", r"\\frac{\1}{\2}", t)
    t = re.sub(r"^(-?)(\d+)/(\d+)$", r"\1\\frac{\2}{\3}", t)
    t = re.sub(r"(?<![\d.])\.(?=\d)", "0.", t)
    t = re.sub(r"(?<=\d)\.0+$", "", t)
    t = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", t) if re.fullmatch(r"-?[\d,.]+", t) else t
    return "\\frac{1}{2}" if t == "0.5" else t.rstrip(".")


def equivalent(a: str | None, b: str | None) -> bool:
    """Equal in one spelling; two nulls are equal, one is not."""
    if a is None or b is None:
        return a is None and b is None
    return normalised(a) == normalised(b)


def split_items(s: str | None) -> list[str]:
    """Items of a tuple, interval or list in brackets; thousands commas don't split."""
    if s is None:
        return []
    t = s.strip()
    if len(t) > 2 and t[0] in "([{" and t[-1] in ")]}" and not re.search(r"[()\[\]]", t[1:-1]):
        inner = t[1:-1]
        if not re.fullmatch(r"\s*-?\d{1,3}(,\d{3})+(\.\d+)?\s*", inner):
            return [x.strip() for x in inner.split(",")]
    return [t]


_TEXTUAL = [(re.compile(r"(\d+(?:\.\d+)?)\s*million\b", re.I), 10**6), (re.compile(r"(\d+(?:\.\d+)?)\s*billion\b", re.I), 10**9), (re.compile(r"(\d+(?:\.\d+)?)\s*trillion\b", re.I), 10**12)]


def plain_expression(s: str | None) -> str | None:
    """An expression as plain text: words for powers of ten, mixed numbers, fraction and root commands written out."""
    if s is None:
        return None
    t = re.sub(r"\\text\{\s*([^{}]*)\s*\}", r"\1", s).replace("\\%", "%").replace("\\$", "$").replace("$", "").replace(" or ", " , ").replace(" and ", " , ")
    for pattern, scale in _TEXTUAL:
        t = pattern.sub(lambda m, scale=scale: format(Fraction(m[1]) * scale, "") if "/" not in str(Fraction(m[1]) * scale) else m[0], t)
    t = _UNIT.sub("", t)
    t = re.sub(r"(\d+)\s*\\[td]?frac\{(\d+)\}\{(\d+)\}", r"\1+\2/\3", t)
    t = re.sub(r"\\[td]?frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", t)
    t = re.sub(r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)", t).replace("\\pi", "pi").replace("\\cdot", "*").replace("\\times", "*").replace("^", "**")
    t = re.sub(r"(?<=\d)\s+(\d+)/(\d+)\b", r"+\1/\2", t).replace("{", "").replace("}", "").replace("\\", "").replace(" ", "").lower()
    n = as_number(t)
    return str(int(n)) if n is not None and abs(n) < 1e15 and n == int(n) and "/" not in t else t


_ARITHMETIC = re.compile(r"[\d.+\-*/() ]+|sqrt|pi")


def evaluated(s: str | None, pi: float = math.pi) -> float | None:
    """Value of an arithmetic expression with + - * / ** ( ), sqrt and pi, by a parser of its own; None if it is another."""
    if not s or _ARITHMETIC.sub("", s):
        return None
    tokens = re.findall(r"\d+\.?\d*|\.\d+|\*\*|sqrt|pi|[-+*/()]", s)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def total() -> float:
        v = product()
        while peek() in ("+", "-"):
            v = v + product() if take() == "+" else v - product()
        return v

    def product() -> float:
        v = signed()
        while peek() in ("*", "/") or peek() in ("(", "sqrt", "pi"):
            if peek() in ("(", "sqrt", "pi"):
                v *= signed()
            else:
                v = v * signed() if take() == "*" else v / signed()
        return v

    def signed() -> float:
        if peek() in ("-", "+"):
            return -signed() if take() == "-" else signed()
        v = atom()
        if peek() == "**":
            take()
            power = signed()
            if abs(power) > 64 or abs(v) > 1e6:
                raise ValueError("too large")
            v = v**power
        return v

    def atom() -> float:
        t = take()
        if t == "(":
            v = total()
            if take() != ")":
                raise ValueError("brackets")
            return v
        if t == "sqrt":
            return math.sqrt(atom())
        return pi if t == "pi" else float(t)

    try:
        v = total()
        return float(v) if at == len(tokens) and not isinstance(v, complex) and math.isfinite(v) else None
    except (IndexError, ValueError, ZeroDivisionError, OverflowError, TypeError, RecursionError):
        return None


def graded(given: str | None, truth: str | None) -> bool:
    """Whether an answer is right: equal in one spelling, or item by item as plain expressions. An unreduced fraction must
    be written the same; a whole number must be met by a whole number; other items are compared by value."""
    if given is None or truth is None:
        return False
    if equivalent(given, truth):
        return True
    a, b = split_items(plain_expression(given)), split_items(plain_expression(truth))
    g, t = (given or "").strip(), (truth or "").strip()
    if len(a) != len(b) or len(b) > 1 and (g[:1] != t[:1] or g[-1:] != t[-1:]):
        return False

    def one(x: str, y: str) -> bool:
        if x == y:
            return True
        fraction = re.compile(r"-?\(?\d+\)?/\(?\d+\)?")
        if fraction.fullmatch(x) and fraction.fullmatch(y):
            return False
        whole = lambda s: bool(re.fullmatch(r"-?\d+", s))
        if whole(y) and not whole(x):
            return False
        p, q = evaluated(x), evaluated(y)
        return p is not None and q is not None and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-12) or algebra.same(x, y)

    return all(one(x, y) for x, y in zip(a, b))


def close_numbers(a: str | None, b: str | None, percent: bool = True, tolerance: float = 1e-4) -> bool:
    """Numbers close by a relative tolerance; with `percent` also a hundredth or hundredfold of the reference."""
    x, y = as_number(a), as_number(b)
    if x is None or y is None:
        return False
    return any(math.isclose(x, r, rel_tol=tolerance) for r in ((y / 100, y, y * 100) if percent else (y,)))


def math_equal(a: str | None, b: str | None, percent: bool = True, tolerance: float = 1e-4) -> bool:
    """Equal as texts, close as numbers, equal item by item in brackets or matrices, or close as expressions."""
    if a is None or b is None:
        return False
    s, t = str(a).strip(), str(b).strip()
    if s.lower() == t.lower() or close_numbers(s, t, percent, tolerance):
        return True
    # brackets around one value say nothing; around several they are an interval's or a list's ends and must be the same
    single = lambda x: len(split_items(x)) == 1
    bare = lambda x: re.sub(r"[()\[\]{}\s]" if single(x) else r"\s", "", x).lower()
    if bare(s) and bare(s) == bare(t) and single(s) == single(t):
        return True
    rows = lambda x: re.findall(r"\\begin\{[pb]?matrix\}(.*?)\\end\{[pb]?matrix\}", x, re.S)
    if rows(s) and rows(t):
        cells = lambda x: [[c.strip() for c in r.split("&")] for r in re.split(r"\\\\", rows(x)[0]) if r.strip()]
        p, q = cells(s), cells(t)
        return len(p) == len(q) and all(len(x) == len(y) and all(math_equal(m, n, percent, tolerance) for m, n in zip(x, y)) for x, y in zip(p, q))
    p, q = split_items(s), split_items(t)
    if len(p) == len(q) > 1:
        return s[0] == t[0] and s[-1] == t[-1] and all(math_equal(x, y, percent, tolerance) for x, y in zip(p, q))
    if s.count("=") == t.count("=") == 1:
        (a1, b1), (a2, b2) = ([plain_expression(y) or "" for y in x.split("=")] for x in (s, t))
        u, v = evaluated(b1), evaluated(b2)
        if a1 == a2 and u is not None and v is not None and math.isclose(u, v, rel_tol=tolerance):
            return True
        one, other = f"({a1})-({b1})", f"({a2})-({b2})"  # the same equation, either way round
        return algebra.same(one, other) or algebra.same(one, f"-({other})")
    u, v = evaluated(plain_expression(s)), evaluated(plain_expression(t))
    if u is not None and v is not None and math.isclose(u, v, rel_tol=tolerance, abs_tol=1e-12):
        return True
    return algebra.same(plain_expression(s), plain_expression(t))


def interval_text(s: str | None) -> str | None:
    """Interval(a, b), Interval.open, .Lopen and .Ropen in brackets."""
    if s is None:
        return None
    shapes = {"Interval.open": "()", "Interval.Lopen": "(]", "Interval.Ropen": "[)", "Interval": "[]"}
    for name, ends in shapes.items():
        s = re.sub(re.escape(name) + r"\(([^()]*)\)", lambda m, ends=ends: ends[0] + m[1] + ends[1], s)
    return s


def in_base(s: str | None) -> str | None:
    """Without a base written as an index, as 1011_2."""
    return None if s is None else s.split("_")[0] if re.fullmatch(r"[0-9a-zA-Z]+_\{?\d+\}?", s.strip()) else s


def outputs_match(given: str | None, wanted: str | None) -> bool:
    """A program's recorded output against the wanted: equal, equal stripped, equal by lines stripped, close by numbers,
    or the same words on each line in any order."""
    if given is None or wanted is None:
        return False
    if given == wanted or given.strip() == wanted.strip():
        return True
    a, b = ([x.strip() for x in t.strip().splitlines() if x.strip()] for t in (given, wanted))
    if a == b:
        return True
    x, y = " ".join(a).split(), " ".join(b).split()
    if len(x) == len(y):
        p, q = [as_number(v) for v in x], [as_number(v) for v in y]
        if all(v is not None for v in p + q) and all(abs(u - v) <= 1e-8 + 1e-5 * abs(v) for u, v in zip(p, q)):
            return True
    return len(a) == len(b) and all(set(u.split()) == set(v.split()) for u, v in zip(a, b))


def marked_answer(text: str | None) -> tuple[bool, str]:
    """(whether an answer with a digit was found, the answer): the last box, else what follows the last 'answer is' or
    'answer:' up to the sentence's end, else what follows the last 'is' or '='."""
    if not text:
        return False, ""
    box = last_box(text)
    if box is not None:
        return any(c.isdigit() for c in box), box
    low = text.lower()
    for mark in ("answer is", "answer:", "answer :"):
        at = low.rfind(mark)
        if at >= 0:
            text = text[at + len(mark) :]
            break
    part = text.strip().split("\n")[0].split(". ")[0].strip()
    for mark in (" be ", " is ", "="):
        if mark in part:
            part = part.rsplit(mark, 1)[1].strip()
    part = part.strip(" .:$")
    return any(c.isdigit() for c in part), part


#: What leads an answer in free-form tasks.
FREE_LEADS = ["The answer is: ", "The answer is ", "The final answer is: ", "The final answer is "]
_WRAPPED = re.compile(r"^\$(.*)\$$|^\\\((.*)\\\)$|^\\boxed\{(.*)\}$|^\\text\{(.*)\}$|^\*\*(.*)\*\*$", re.S)


def free_form(text: str | None, reference: bool = False) -> str | None:
    """An answer of a free-form task in one spelling: what follows a lead, without a trailing stop and wrappers, in lower
    case, first line only; ', ' becomes ','. A reference has no lead to look for."""
    if text is None:
        return None
    out = text.strip()
    if not reference:
        for lead in FREE_LEADS:
            if lead in out:
                out = out.rpartition(lead)[2].strip()
                break
    out = out.removesuffix(".").strip()
    while m := _WRAPPED.match(out):
        out = next(g for g in m.groups() if g is not None).strip()
    return out.lower().replace(", ", ",").replace("**", "").split("\n")[0].strip()


def graded_with_format(response: str | None, truth: str | None) -> tuple[bool, bool, str]:
    """(right, found in the asked form, answer): the marked answer graded, pi taken for its symbol and for 3.14."""
    found, given = marked_answer(response)
    if truth is None:
        return False, found, given
    plain, want = plain_expression(given), plain_expression(truth)
    right = graded(given, truth) or math_equal(given, truth)
    if not right and plain and want and "pi" in want + plain:
        u, v = evaluated(plain, 3.14), evaluated(want, math.pi)
        w = evaluated(want, 3.14)
        p = evaluated(plain)
        right = any(x is not None and y is not None and math.isclose(x, y, rel_tol=1e-4) for x, y in ((u, v), (u, w), (p, w)))
    return right, found, given


def says_yes(judge: Column | str) -> Column:
    """Whether a judge's reply to an equality question is yes; null and other replies are not."""
    return F.coalesce(F.lower(F.trim(_c(judge))) == "yes", F.lit(False))


# ------------------------------------------------------------------------------------------- column functions
def _text_udf(f, *cols: Column | str) -> Column:  # noqa: ANN001
    @F.arrow_udf("string")
    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([f(*row) for row in zip(*(a.to_pylist() for a in arrays))], pa.string())

    return run(*cols)


def _bool_udf(f, *cols: Column | str) -> Column:  # noqa: ANN001
    @F.arrow_udf("boolean")
    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([bool(f(*row)) for row in zip(*(a.to_pylist() for a in arrays))], pa.bool_())

    return run(*cols)


#: As _BOX, for the JVM: possessive, so that neither time nor stack grow with the length of what is in a box.
_BOX_JVM = r"\\boxed\{((?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+)\}"


def box_column(text: Column | str) -> Column:
    """last_box in the JVM."""
    return F.try_element_at(F.regexp_extract_all(_c(text), F.lit(_BOX_JVM), F.lit(1)), F.lit(-1))


def box_part_column(text: Column | str) -> Column:
    return _text_udf(last_boxed_part, text)


def unboxed_column(part: Column | str) -> Column:
    return _text_udf(unboxed, part)


def marked_column(text: Column | str) -> Column:
    return _text_udf(lambda t: marked_answer(t)[1], text)


def free_form_column(text: Column | str) -> Column:
    return _text_udf(free_form, text)


def answer_column(text: Column | str) -> Column:
    return _text_udf(final_answer, text)


def normalised_column(text: Column | str) -> Column:
    return _text_udf(normalised, text)


def equivalent_column(a: Column | str, b: Column | str) -> Column:
    return _bool_udf(equivalent, a, b)


def graded_column(a: Column | str, b: Column | str) -> Column:
    return _bool_udf(graded, a, b)


def math_equal_column(a: Column | str, b: Column | str) -> Column:
    return _bool_udf(math_equal, a, b)


def outputs_column(a: Column | str, b: Column | str) -> Column:
    return _bool_udf(outputs_match, a, b)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_answer(text: Column | str) -> Column:
    """First number behind '####', without commas and dollar signs; null where there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(_c(text), "#### (\\-?[0-9\\.\\,]+)", 1), "[,$]", ""), F.lit(""))


def last_number(text: Column | str) -> Column:
    """Last run of digits, points and commas that isn't a lone point; where all are, the first."""
    found = F.regexp_extract_all(_c(text), F.lit("(\\-?[0-9\\.\\,]+)"), F.lit(1))
    good = F.filter(found, lambda x: (x != "") & (x != "."))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def choice_letter(text: Column | str, letters: str = "A-D") -> Column:
    """The letter behind 'Answer:', any case; null where there is none."""
    return F.nullif(F.regexp_extract(_c(text), f"(?i)Answer[ \\t]*:[ \\t]*\\$?([{letters}])\\$?", 1), F.lit(""))


def contained_letter(text: Column | str, most: int = 10) -> Column:
    """The first of A, B, C ... that the text contains; null where it contains none."""
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(most)])
    return F.get(F.filter(letters, lambda x: F.contains(_c(text), x)), F.lit(0))


def box_to_line_end(text: Column | str) -> Column:
    """From \\boxed{ to the last closing brace of its line."""
    return F.nullif(F.regexp_extract(_c(text), "\\\\boxed\\{(.*)\\}", 1), F.lit(""))


#: How languages lead up to a lettered answer, and the letters of other scripts.
MULTILINGUAL_LEADS = ["Answer", "উত্তর", "उत्तर", "উত্তরঃ", "Antwort", "답변", "정답", "답", "答案", "答", "答复", "答曰", "الإجابة", "الجواب", "إجابة", "الإجابة النهائية", "الإجابة الصحيحة", "الإجابة الصحيحة هي", "الإجابة هي", "الجواب النهائي", "Respuesta", "Risposta", "答え", "回答", "解答", "Jawaban", "Réponse", "Resposta", "Jibu", "Idahun", "Ìdáhùn", "Idáhùn", "Àmọ̀nà", "Àdáhùn", "Ànúgọ", "Àṣàyàn"]
SCRIPT_LETTERS = {"أ": "A", "ب": "B", "ج": "C", "د": "D", "অ": "A", "ব": "B", "ড": "C", "ঢ": "D", "Ａ": "A", "Ｂ": "B", "Ｃ": "C", "Ｄ": "D"}


def multilingual_letter(text: Column | str) -> Column:
    """The letter behind a lead in any of the languages, as a Latin letter."""
    found = F.regexp_extract(_c(text), "(?i)(?:" + "|".join(MULTILINGUAL_LEADS) + ")\\s*[:：][ \\t]*([A-D" + "".join(SCRIPT_LETTERS) + "])", 1)
    return F.nullif(F.upper(F.translate(found, "".join(SCRIPT_LETTERS), "".join(SCRIPT_LETTERS.values()))), F.lit(""))


#: Marks that are taken out of a response before letters are looked for.
MARKUP = ["**", "$\\boxed{", "}$", "\\$", "$\\text{", "$", "\\mathrm{", "\\{", "\\text", "\\(", "\\mathbf{", "{", "\\boxed"]


def unmarked(text: Column | str) -> Column:
    out = _c(text)
    for mark in MARKUP:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def last_python_block(text: Column | str) -> Column:
    """What stands between the last '```python' and the next fence."""
    return F.substring_index(F.substring_index(_c(text), "```python", -1), "```", 1)


#: Substitutions, removed words and patterns of the usual normalisation of quantitative answers.
MINERVA_REPLACED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
MINERVA_REMOVED = ["square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots"]
MINERVA_PATTERNS = [("(.*?)(\\$)(.*?)(\\$)(.*)", "\\$$3\\$"), ("(\\\\text\\{)(.*?)(\\})", "$2"), ("(\\\\textbf\\{)(.*?)(\\})", "$2"), ("(\\\\overline\\{)(.*?)(\\})", "$2"), ("(\\\\boxed\\{)(.*)(\\})", "$2"), ("(frac)([^{])(.)", "frac{$2}{$3}"), ("(sqrt)([^{])", "sqrt{$2}")]


def minerva(text: Column | str) -> Column:
    """Final answers in one spelling by substitutions in SQL: what follows the last '=', without words and units, with
    braces round fractions and roots; commas go from whole numbers."""
    out = F.element_at(F.split(_c(text), "=", -1), -1)
    for old, new in [*MINERVA_REPLACED, *[(w, "") for w in MINERVA_REMOVED]]:
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, new in MINERVA_PATTERNS:
        out = F.regexp_replace(out, pattern, new)
    out = F.replace(out, F.lit("$"), F.lit(""))
    whole = F.replace(out, F.lit(","), F.lit(""))
    return F.when(whole.rlike("^\\d+$"), whole).otherwise(out)


def minerva_sql(text: str) -> str:
    """minerva in DuckDB's SQL."""
    quoted = lambda x: x.replace("'", "''")
    out = f"list_last(string_split({text}, '='))"
    for old, new in [*MINERVA_REPLACED, *[(w, "") for w in MINERVA_REMOVED]]:
        out = f"replace({out}, '{quoted(old)}', '{quoted(new)}')"
    for pattern, new in MINERVA_PATTERNS:
        back = re.sub(r"\\\$|\$(\d)", lambda m: "\\" + m[1] if m[1] else "$", new)
        out = f"regexp_replace({out}, '{quoted(pattern)}', '{back}', 'g')"
    out = f"replace({out}, '$', '')"
    return f"(CASE WHEN regexp_full_match(replace({out}, ',', ''), '[0-9]+') THEN replace({out}, ',', '') ELSE {out} END)"


def stated_answer(text: Column | str) -> Column:
    """What follows the last 'Answer:' on its line, '[INVALID]' where there is none."""
    found = F.regexp_extract_all(_c(text), F.lit("(?i)Answer\\s*:\\s*([^\\n]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))


def loosely_equal(a: Column | str, b: Column | str) -> Column:
    """Equal; equal without round brackets around one letter; equal as numbers, without quotes, without square brackets,
    or without a trailing question mark. Nulls are not equal."""
    x, y = _c(a), _c(b)
    letter = lambda s: F.when(s.rlike("^\\(.\\)$"), F.substring(s, 2, 1)).otherwise(s)
    as_double = lambda s: F.when(s.rlike("^\\s*[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?\\s*$"), F.trim(s).try_cast("double"))
    bare = lambda s: F.replace(s, F.lit("'"), F.lit(""))
    inner = lambda s: F.regexp_replace(s, "^\\[|\\]$", "")
    asked = lambda s: F.regexp_replace(s, "\\?$", "")
    tests = (x == y) | (letter(x) == letter(y)) | (as_double(x) == as_double(y)) | (bare(x) == bare(y)) | (inner(x) == inner(y)) | (asked(x) == asked(y))
    return F.coalesce(tests, F.lit(False))
