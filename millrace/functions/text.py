"""Column functions on text, paths and addresses. All run in the JVM; a null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters at which Python's splitlines ends a line.
LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
#: What Python's strip removes.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_END_CLASS = "[\\n\\x0B\\x0C\\r\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
_SPACE_CLASS = "[\\s\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(s: Column | str) -> Column:
    """Unicode white space removed at both ends."""
    return F.regexp_replace(_c(s), f"^{_SPACE_CLASS}+|{_SPACE_CLASS}+$", "")


def line_count(s: Column | str) -> Column:
    """Lines, as splitlines counts them: no line follows a last line end."""
    parts = F.size(F.split(_c(s), f"\\r\\n|{_END_CLASS}", -1))
    return F.when(_c(s) == "", 0).otherwise(parts - F.when(_c(s).rlike(f"{_END_CLASS}\\z"), 1).otherwise(0))


def unix_lines(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), "\\r\\n?", "\n")


def repo_name(url: Column | str) -> Column:
    """Last segment of an address's path, if the path has two segments or more. An address without a scheme, as ssh has
    them, is all path."""
    path = F.regexp_extract(strip(url), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    parts = F.filter(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/", -1), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1))


def repo_base(url: Column | str, exact: bool = True) -> Column:
    """Last part of an address without '.git'. exact=False trims trailing characters of '.git' one by one instead, as
    older catalogues were written."""
    s = F.regexp_replace(_c(url), "\\.git$" if exact else "[.git]+$", "")
    return F.element_at(F.split(s, "/", -1), -1)


def owner_name(url: Column | str) -> Column:
    """'owner-name' of the last two parts, points as underscores."""
    parts = F.split(F.regexp_replace(_c(url), "/+$|\\.git/*$", ""), "/", -1)
    return F.when(F.size(parts) >= 2, F.replace(F.concat_ws("-", F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1)), F.lit("."), F.lit("_")))


def relative_path(path: Column | str, root: str) -> Column:
    """The path below a root, with slashes, beginning with one."""
    return F.concat(F.lit("/"), F.regexp_replace(F.replace(F.regexp_replace(_c(path), "^file:/*(?=/)", ""), F.lit("\\"), F.lit("/")), "^" + root.rstrip("/").replace("\\", "/") + "/*", ""))


def module_name(path: Column | str) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(_c(path), "^/+", ""), "\\.py$", ""), F.lit("/"), F.lit("."))


def suffixes(module: Column | str) -> Column:
    """All dotted suffixes of a module name, longest first."""
    parts = F.split(_c(module), "\\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def package(name: Column | str) -> Column:
    return F.split_part(_c(name), F.lit("."), F.lit(1))


def middle_cut(s: Column | str, length: int, mark: str = "...(truncated) ...") -> Column:
    """The first and last halves of a string longer than length, around a mark."""
    c = _c(s)
    return F.when(F.length(c) <= length, c).otherwise(F.concat(F.substring(c, 1, length // 2), F.lit(mark), F.substring(c, -(length // 2), length // 2)))


def tidied(s: Column | str) -> Column:
    """Stripped; ' [title]' becomes a stop, other bracketed parts within a line (up to \\n) go, double spaces become single ones once."""
    c = F.replace(strip(s), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(c, "\\[[^\\n]*?\\]", ""), F.lit("  "), F.lit(" "))


def capitalised(s: Column | str) -> Column:
    """First letter upper case, the rest lower case."""
    c = _c(s)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.expr("substring(`{0}`, 2)".format(s)) if isinstance(s, str) else F.substring(c, 2, 1 << 30)))


def with_instruction(question: Column | str, instruction: str) -> Column:
    return F.concat(_c(question), F.lit(" " + instruction))


def options_block(options: Column | str, most: int = 10) -> Column:
    """'(A): first', '(B): second' ... a line each; options beyond `most` are left out."""
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(most)])
    return F.array_join(F.transform(F.slice(_c(options), 1, most), lambda o, i: F.concat(F.lit("("), F.get(letters, i), F.lit("): "), o, F.lit("\n"))), "")


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with {names} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def repeated_mark(s: Column | str, mark: str, token: str, counts: Column) -> Column:
    """Each mark in turn becomes as many tokens as the array of counts says; marks beyond the counts stay."""
    parts = F.split(_c(s), "\\Q" + mark + "\\E", -1)
    n = F.size(parts)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), lambda p, i: F.concat(F.coalesce(F.repeat(F.lit(token), F.get(counts, i)), F.lit(mark)), p)), ""))


def answer_part(text: Column | str, stops: list[str]) -> Column:
    """The part of a chat text behind the assistant's mark (or the last 'Assistant:'), cut at the first stop word."""
    c = _c(text)
    c = F.when(F.contains(c, F.lit("<|im_start|>assistant")), F.substring_index(c, "<|im_start|>assistant", -1)).otherwise(F.substring_index(c, "Assistant:", -1))
    for stop in stops:
        c = F.substring_index(c, stop, 1)
    return strip(c)


def without(text: Column | str, token: str) -> Column:
    return F.replace(_c(text), F.lit(token), F.lit(""))
