"""Problem 2: credentials in source code and settings files, found and redacted.

Method: every place where a value could stand (string literals, literals put together, assignments, headers, URLs,
comments, key blocks) becomes a candidate. A logistic regression on the character Markov likelihood of the value, the
identifiers around it and the file's path decides; it is trained on the candidates of all files that patterns label weakly,
calibrated on held-out ones, and scores above one half are redacted. The texts are read once: their candidates are written,
equal ones are folded and counted, and the counts of the likelihoods and each step of the regression are sums over them.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import removed, written

#: What a redacted value becomes.
MARK = "REDACTED"
#: Files of each table that `sample` takes to be looked at, in blocks of neighbouring ids. No model is trained on them.
SAMPLE_FILES = 750
SAMPLE_BLOCK = 32
#: Characters of files whose candidates are scored at once in a worker.
PART = 400_000
THRESHOLD = 0.5
#: Values of fewer characters are no credentials.
SHORTEST = 4

_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PIECES = re.compile(r"""[bBrR]?(["'])([^"'\\\s]{2,})\1(?:\s*+\+?\s*+\\?\s*+[bBrR]?(["'])[^"'\\\s]{2,}\3)+""")
_PIECE = re.compile(r"""(["'])([^"'\\\s]{2,})\1""")
_URL = re.compile(r"""(?<![\w+.-])[\d+._-]*+[A-Za-z][\w+.-]*+://[^\s"'/:@{}<>$]*:([^\s"'/@{}<>]{4,})@""")
_HEADER = re.compile(r"""\b(Bearer|Basic|token|apikey)\s+([^\s"'\\{}<>$]{8,})""", re.I)
_QUOTED = re.compile(r"""(\\?["'])([^"'\\\s]{4,})\1""")
_QUERY = re.compile(r"""[?&;]([\w.-]+)=([^\s"'&#<>(){}\\$;]{4,})""")
_PLAIN = re.compile(r"""(?<![\w.-])[\d.-]*+([A-Za-z_][\w.-]*+)\s?[=:]\s?([^\s"'\\<>(){}\[\],;&|`]{4,})""")
#: A string of several words is a value only where a name that says so is given it.
_PHRASE = re.compile(r"""(?i)(?<![a-z])(?:pass(?:word|wd|phrase|wort)?|pwd|secret|token|api_?key)["'\])]*+\s*+[:=]\s*+(["'])([^"'\\\n]+)\1""")
#: The identifier before a place, read backwards: a string's prefix, what stands between, the name.
_NAME_BEFORE = re.compile(r"""(?:[bBrRuUfF]{1,2}[^\w]{1,24}|[^\w]{0,24})([\w-]*[A-Za-z_])""")
#: Words before a value that name nothing; the identifier before them counts.
_EMPTY_NAMES = {"default", "value", "return", "yield", "b", "r", "u", "f", "br", "rb", "old", "new", "is", "set", "str", "print"}
_INNER = re.compile(r"([A-Za-z_][\w.-]*)=(?=[^=]{6})")
_NAME_AFTER = re.compile(r"""^["')\],;]*[ \t]*#[ \t]*([A-Za-z_][\w-]*)""")

#: Words of identifiers that name credentials, and words that name other long values.
SECRET_WORDS = ["key", "secret", "token", "password", "passwd", "passwort", "pwd", "pass", "jwt", "session", "auth", "cred", "credential", "bearer", "basic", "apikey", "pgpassword", "dsn", "login", "private"]
OTHER_WORDS = ["commit", "etag", "checksum", "sha", "sha1", "sha256", "md5", "hash", "digest", "rev", "revision", "run", "uuid", "guid", "public", "pub", "icon", "image", "order", "pad", "project", "dir", "path", "file", "model", "version", "build", "trace", "request", "field", "hint", "name", "fingerprint", "etags", "integrity"]
#: Openings by which services mark their keys.
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "hf_", "sk-", "sk_live_", "AIza", "eyJ", "xoxb-", "xoxp-", "npm_", "pypi-"]
#: What stands where a credential will be filled in.
PLACEHOLDERS = ["your", "xxx", "changeme", "change_me", "placeholder", "replace", "insert", "paste", "todo", "example", "dummy", "redacted", "fill", "none", "null", "***", "..."]


@dataclass
class Candidate:
    start: int
    end: int
    value: str
    name: str
    kind: str


def candidates(text: str) -> list[Candidate]:
    """Places of a text at which a value stands, each character in one place at most: earlier patterns go first.

    The places of one pattern come in order, so each pattern is merged into the sorted list of places taken before it; the
    work grows with the text and not with the square of its values.
    """
    out: list[Candidate] = []
    taken: list[tuple[int, int]] = []  # sorted, apart from one another

    def before(at: int) -> str:
        name = ""
        for _ in range(3):
            m = _NAME_BEFORE.match(text[max(0, at - 90) : at][::-1])
            if not m:
                break
            name = m[1][::-1]
            if name.lower() not in _EMPTY_NAMES:
                break
            at -= m.end()
        return name

    def after(at: int) -> str:
        m = _NAME_AFTER.match(text[at : at + 60])
        return m[1] if m else ""

    def pem() -> Iterator[tuple]:
        at = 0
        while m := _PEM.search(text, at):
            end = _PEM_END.search(text, m.end())
            yield m.start(), end.end() if end else m.end(), lambda m=m, end=end: (text[m.end() : end.start()] if end else "", "private_key"), "pem"
            at = end.end() if end else m.end()

    def url() -> Iterator[tuple]:
        for m in _URL.finditer(text):
            yield *m.span(1), lambda m=m: (m[1], "password"), "url"

    def query() -> Iterator[tuple]:
        for m in _QUERY.finditer(text):
            yield *m.span(2), lambda m=m: (m[2], m[1]), "plain"

    def header() -> Iterator[tuple]:
        for m in _HEADER.finditer(text):
            value = m[2].rstrip(".,;:")
            yield m.start(2), m.start(2) + len(value), lambda m=m, value=value: (_from_basic(value) if m[1].lower() == "basic" else value, "authorization"), "header"

    def pieces() -> Iterator[tuple]:
        for m in _PIECES.finditer(text):
            value = "".join(p[2] for p in _PIECE.finditer(m[0]))
            if len(value) >= SHORTEST:
                yield *m.span(), lambda m=m, value=value: (value, before(m.start())), "pieces"

    def quoted() -> Iterator[tuple]:
        for m in _QUOTED.finditer(text):
            if "://" not in m[2] and not _PLAIN.fullmatch(m[2]):
                yield *m.span(2), lambda m=m: (m[2], f"{before(m.start())} {after(m.end())}".strip()), "quoted"

    def phrase() -> Iterator[tuple]:
        for m in _PHRASE.finditer(text):
            if len(m[2]) >= SHORTEST and any(c.isspace() for c in m[2].strip()):
                yield *m.span(2), lambda m=m: (m[2], before(m.start(1))), "quoted"

    def plain() -> Iterator[tuple]:
        for m in _PLAIN.finditer(text):
            if not m[2].startswith("//"):
                inner = _INNER.match(m[2])
                at = m.start(2) + inner.end() if inner else m.start(2)
                yield at, m.end(2), lambda m=m, at=at, inner=inner: (text[at : m.end(2)], inner[1] if inner else m[1]), "plain"

    for pattern in (pem, url, query, header, pieces, quoted, phrase, plain):
        k, end, new = 0, -1, []
        for start, stop, rest, kind in pattern():
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if start >= end and (k == len(taken) or taken[k][0] >= stop):
                end = stop
                new.append((start, stop))
                out.append(Candidate(start, stop, *rest(), kind))
        taken = sorted(taken + new)  # two runs that are in order: merged in one pass
    return out


def _from_basic(value: str) -> str:
    """The password of a Basic header's value, or the value where it can't be read."""
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii").partition(":")[2] or value
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return value


_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_ALPHABET = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/=.!#$%@:")}


@lru_cache(maxsize=100_000)
def name_words(name: str) -> frozenset[str]:
    return frozenset({w.lower() for w in _SPLIT.findall(name)} | {n.lower() for n in name.split()})


@lru_cache(maxsize=100_000)
def _name_flags(name: str) -> tuple[bool, bool]:
    """Whether a name speaks of a credential, and of another long value."""
    words = name_words(name)
    return not words.isdisjoint(_SECRETS), not words.isdisjoint(_OTHERS)


_SECRETS, _OTHERS = frozenset(SECRET_WORDS), frozenset(OTHER_WORDS)
_CODE = np.full(128, len(_ALPHABET), np.int64)
for _c, _i in _ALPHABET.items():
    _CODE[ord(_c)] = _i


@dataclass
class Flat:
    """The characters of many values in one array; `at` is where each begins, and at the last place where all end."""

    points: np.ndarray
    at: np.ndarray

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum over each value of a figure of each character."""
        total = np.concatenate((np.zeros(1, x.dtype if x.dtype != bool else np.int64), np.cumsum(x)))
        return total[self.at[1:]] - total[self.at[:-1]]

    def lengths(self) -> np.ndarray:
        return np.diff(self.at)

    def codes(self) -> np.ndarray:
        return np.where(self.points < 128, _CODE[np.minimum(self.points, 127)], len(_ALPHABET))


def flat(values: list[str]) -> Flat:
    points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    return Flat(points, np.concatenate(([0], np.cumsum(np.fromiter(map(len, values), np.int64, len(values))))))


_STATES = len(_ALPHABET) + 1


def steps(values: list[str], times: np.ndarray | None = None) -> np.ndarray:
    """How often each character follows each other within the values, each value so many times: _STATES squared counts."""
    f = flat(values)
    c = f.codes()
    inner = np.ones(len(c), bool)
    inner[f.at[:-1][f.lengths() > 0]] = False
    step = np.flatnonzero(inner)
    weights = None if times is None else np.repeat(times, f.lengths())[step]
    return np.bincount(c[step - 1] * _STATES + c[step], weights, _STATES * _STATES).astype(float)


class Markov:
    """Character bigram model of counts that `steps` gave; likelihood() is the mean log probability of a step."""

    def __init__(self, counts: np.ndarray) -> None:
        counts = counts.reshape(_STATES, _STATES) + 0.3
        self.log = np.log(counts / counts.sum(1, keepdims=True))

    def likelihood(self, f: Flat) -> np.ndarray:
        """Of each value; -5 for one of fewer than two characters."""
        c, n = f.codes(), f.lengths()
        step = np.zeros(len(c))
        if len(c) > 1:
            step[1:] = self.log[c[:-1], c[1:]]
        step[f.at[:-1][n > 0]] = 0.0
        return np.where(n > 1, f.sums(step) / np.maximum(n - 1, 1), -5.0)


_PLACEHOLDER = re.compile("|".join(map(re.escape, PLACEHOLDERS)))


def looks_placed(value: str) -> bool:
    """Whether a value stands for one to be filled in, or refers to a variable."""
    low = value.lower()
    return "${" in value or value[:1] in "$%<{*" or bool(_PLACEHOLDER.search(low)) or len(set(low)) <= 2


def weak_label(c: Candidate) -> int | None:
    """1 or 0 where patterns are sure, else None."""
    words = name_words(c.name)
    value = c.value
    if c.kind == "pem":
        return int(len(re.sub(r"\s|\\n", "", value)) >= 40)
    if not words.isdisjoint(_OTHERS) or not any(map(str.isdigit, value)) or looks_placed(value):
        return 0
    if value.startswith(_PREFIXES) and any(value.startswith(p) and len(value) >= len(p) + 10 for p in PREFIXES):
        return 1
    secret = not words.isdisjoint(_SECRETS) or c.kind in ("url", "header")
    if secret and re.fullmatch(r"[0-9a-f]{20,64}|[A-Za-z0-9+/]{32,}={0,2}", value) and any(map(str.isalpha, value)):
        return 1
    if words & {"password", "pass", "passwd", "pwd", "pgpassword"} and sum(map(str.isalpha, value)) >= 4 and 8 <= len(value) <= 40 and re.search(r"[A-Z]", value):
        return 1
    return None if secret else 0


NAMES = ["random", "prose", "log_length", "digits", "upper", "entropy", "kinds", "secret_name", "other_name", "prefix", "placed", "no_digit", "hex", "url", "header", "pieces", "plain", "path_like", "settings_file", "test_file", "word_digit", "only_number", "secret_and_random", "pem"]


@dataclass
class Model:
    random: Markov
    prose: Markov
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def score(self, cands: list[Candidate], paths: list[str]) -> np.ndarray:
        """Calibrated probability that each candidate, in the file of its path, is a credential."""
        if not cands:
            return np.zeros(0)
        x = (features(cands, paths, self.random, self.prose) - self.mean) / self.scale
        z = np.column_stack([x, np.ones(len(x))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


_WORD_DIGIT = re.compile(r"[A-Za-z][A-Za-z!#$%_-]+\d+[!#$%]?")
_PREFIXES = tuple(PREFIXES)
_BLANKS = re.compile(r"\s|\\n")


@lru_cache(maxsize=20_000)
def _path_flags(path: str) -> tuple[bool, bool]:
    return path.endswith((".env", ".yaml", ".yml", ".json", ".ini", ".toml")), "test" in path.lower() or "example" in path.lower()


def features(cands: list[Candidate], paths: list[str], random: Markov, prose: Markov) -> np.ndarray:
    """NAMES of all candidates at once: character figures come from one flat array of all values."""
    values = [c.value for c in cands]
    f = flat(values)
    p, n = f.points, np.maximum(f.lengths(), 1)
    digit, upper, lower = (p >= 48) & (p <= 57), (p >= 65) & (p <= 90), (p >= 97) & (p <= 122)
    if (p > 127).any():  # letters and digits of other scripts, character by character
        for k in np.flatnonzero(p > 127):
            c = chr(p[k])
            digit[k], upper[k], lower[k] = c.isdigit(), c.isupper(), c.islower()
    digits, uppers, lowers = f.sums(digit), f.sums(upper), f.sums(lower)
    # entropy of the characters of each value
    owner = np.repeat(np.arange(len(cands)), f.lengths())
    key, count = np.unique(owner << 21 | p.astype(np.int64), return_counts=True)
    share = count / n[key >> 21]
    entropy = np.bincount(key >> 21, -share * np.log2(share), minlength=len(cands))
    kind = np.array([c.kind for c in cands])
    named = np.array([_name_flags(c.name) for c in cands], bool).reshape(-1, 2)
    at = np.array([_path_flags(x) for x in paths], bool).reshape(-1, 2)
    url, header = kind == "url", kind == "header"
    secret = named[:, 0] | url | header
    likely = prose.likelihood(f)
    odd = np.clip(random.likelihood(f) - likely, -3.0, 3.0)
    pem = np.array([c.kind == "pem" and len(_BLANKS.sub("", c.value)) >= 40 for c in cands])
    hexadecimal = (f.lengths() >= 16) & (f.sums(((p >= 48) & (p <= 57)) | ((p >= 97) & (p <= 102))) == f.lengths())
    number = (f.lengths() > 0) & (f.sums(digit | np.isin(p, np.array([44, 45, 46, 58, 95], np.uint32))) == f.lengths())
    slashes = f.sums(p == 47) >= 1
    return np.column_stack([
        odd, likely, np.log(n), digits / n, uppers / n, entropy,
        (digits > 0).astype(int) + (uppers > 0) + (lowers > 0) + (digits + uppers + lowers < n), secret, named[:, 1],
        [v.startswith(_PREFIXES) for v in values], [looks_placed(v) for v in values], digits == 0, hexadecimal,
        url, header, kind == "pieces", kind == "plain", slashes & (lowers / n > 0.75) | [v.startswith(("/", "./", "~")) for v in values],
        at[:, 0], at[:, 1],
        [bool(_WORD_DIGIT.fullmatch(v)) for v in values], number, secret * odd, pem,
    ]).astype(float)


def _seeds() -> list[tuple[Candidate, str, int]]:
    """Labelled candidates made by rule, so that a model can be trained where a sample holds few or none."""
    rng = np.random.default_rng(11)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda n, a=alphabet: "".join(a[i] for i in rng.integers(len(a), size=n))
    words = ["river", "maple", "stone", "winter", "copper", "lantern", "orbit", "garden", "signal", "anchor"]
    out = []
    for i in range(160):
        name = ["api_key", "auth_token", "client_secret", "DB_PASSWORD", "session"][i % 5]
        kind = ["quoted", "plain", "pieces", "header", "url"][i // 5 % 5]
        value = draw(40, "0123456789abcdef") if i % 4 == 0 else draw(int(rng.integers(18, 48))) if i % 4 == 1 else PREFIXES[i % 16] + draw(30)
        if i % 4 == 3:
            value = words[i % 10].title() + "!-_#"[i % 4] * (i % 3 > 0) + words[(i * 7 + 3) % 10] + str(rng.integers(100, 9999)) + "!$"[i % 2] * (i % 5 > 2)
        out.append((Candidate(0, 0, value, name, kind), ["a.py", "b.sh", "c.yaml", "d.env"][i % 4], 1))
        out.append((Candidate(0, 0, draw(40, "0123456789abcdef"), ["commit", "etag", "checksum", "model_rev", "run_id"][i % 5], kind if kind in ("quoted", "plain") else "quoted"), "a.py", 0))
        out.append((Candidate(0, 0, ["your_api_key_here", "xxxxxxxxxxxx", "$API_KEY", "<api_key>", "changeme123"][i % 5], name, "quoted"), "a.py", 0))
        out.append((Candidate(0, 0, [words[i % 10] + "_" + words[i // 10 % 10], f"/data/{words[i % 10]}/{i}", f"v{i}.2.{i % 9}", f"{words[i % 10]}-{i}", f"{words[i % 10]}_hint"][i % 5], ["name", "dir", "mode", "run", name][i % 5], ["quoted", "plain"][i % 2]), "a.py", 0))
    return out


_LOOSE = re.compile(r"[A-Za-z_]{4,}")
#: Names and paths that stand for all that the features take for the same.
_ABOUT = {(False, False): "", (True, False): "key", (False, True): "commit", (True, True): "key commit"}
_PLACES = {(False, False): "", (True, False): ".env", (False, True): "test", (True, True): "test.env"}

#: Labelled candidates that features were taken of: features, labels, how often each occurs, which are held out.
Part = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _part(cands: list[Candidate], paths: list[str], labels: list[int], times: list[int], random: Markov, prose: Markov) -> Part:
    """Every second value is held out, as its hash says, in all its places."""
    held = np.array([zlib.crc32(c.value.encode("utf-8", "surrogatepass")) & 1 for c in cands], bool)
    return features(cands, paths, random, prose), np.array(labels, float), np.array(times, float), held


def _markovs(of_random: np.ndarray, of_prose: np.ndarray) -> tuple[Markov, Markov]:
    """The models of credentials and of all else, from counts of steps and the seeds'."""
    seeds = _seeds()
    values = lambda label: [c.value for c, _, y in seeds if y == label]
    return Markov(of_random + steps(values(1))), Markov(of_prose + steps(values(0) + SECRET_WORDS + OTHER_WORDS))


def train(files: list[tuple[str, str]]) -> Model:
    """The model from a list of (path, text), by the steps that `trained` takes over a table."""
    found = [(c, p, weak_label(c)) for p, t in files for c in candidates(t)]
    rows = Counter((c.value, c.kind, _ABOUT[_name_flags(c.name)], _PLACES[_path_flags(p)], y) for c, p, y in found if y is not None)
    of = lambda label: [r for r in rows if r[4] == label and (label == 0 or r[1] != "pem")]
    count = lambda part: steps([r[0] for r in part], np.array([rows[r] for r in part], float))
    random, prose = _markovs(count(of(1)), count(of(0)) + steps([w for _, t in files for w in _LOOSE.findall(t)]))
    part = _part([Candidate(0, 0, r[0], r[2], r[1]) for r in rows], [r[3] for r in rows], [r[4] for r in rows], list(rows.values()), random, prose) if rows else None
    return _fitted(random, prose, lambda f: f(*part) if part else 0.0)


def trained(rows: DataFrame) -> Model:
    """The model from all labelled candidates of a written table that `listed` gave with the steps of loose words.

    Only sums come to the driver: counts of steps, and of each task one gradient and Hessian a step of the regression.
    """
    rows_of = lambda b: (b.column(k).to_pylist() for k in range(6))
    labelled = rows.where("label is not null").groupBy("value", "kind", "about", "place", "label").agg(F.count("*").alias("n"))
    labelled = written(labelled, "labels")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _STATES * _STATES))
        for b in _parts(batches, 0):
            values, kinds, _, _, labels, times = rows_of(b)
            for label in (0, 1):
                part = [(v, n) for v, k, y, n in zip(values, kinds, labels, times) if y == label and (y == 0 or k != "pem")]
                total[label] += steps([v for v, _ in part], np.array([n for _, n in part], float))
        yield from (_step_rows(x, label) for label, x in enumerate(total))

    counted = labelled.mapInArrow(count, "label int, step int, n long").unionByName(rows.where("step is not null").select(F.lit(0).alias("label"), "step", "n"))
    totals = np.zeros((2, _STATES * _STATES))
    for label, step, n in counted.groupBy("label", "step").agg(F.sum("n")).collect():
        totals[label, step] = n
    random, prose = _markovs(totals[1], totals[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 0):
            values, kinds, about, places, labels, times = rows_of(b)
            part = _part([Candidate(0, 0, v, a, k) for v, a, k in zip(values, about, kinds)], places, labels, times, random, prose)
            # by columns: most are flags, which are written in few bytes
            yield pa.RecordBatch.from_arrays([pa.array([part[0].T.tobytes()]), *(pa.array([x.tobytes()]) for x in part[1:])], ["x", "y", "n", "held"])

    parts = written(labelled.mapInArrow(measure, "x binary, y binary, n binary, held binary"), "features")

    def total(f: Callable[..., np.ndarray]) -> np.ndarray | float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = 0.0
            for b in batches:
                for x, y, n, held in zip(*(b.column(k).to_pylist() for k in range(4))):
                    y, n, held = np.frombuffer(y), np.frombuffer(n), np.frombuffer(held, bool)
                    out = out + f(np.frombuffer(x).reshape(-1, len(y)).T, y, n, held)
            if not np.isscalar(out):
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["sums"])

        return sum((np.frombuffer(r[0]) for r in parts.mapInArrow(run, "sums binary").collect()), 0.0)

    model = _fitted(random, prose, total)
    removed(labelled, parts)
    return model


def _step_rows(counts: np.ndarray, label: int) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["label", "step", "n"])


def _fitted(random: Markov, prose: Markov, total: Callable[[Callable[..., np.ndarray]], np.ndarray | float]) -> Model:
    """The regression on the seeds and on all parts that `total` sums a function over. Held-out values calibrate it."""
    seeds = _seeds()
    first = _part([c for c, _, _ in seeds], [p for _, p, _ in seeds], [y for _, _, y in seeds], [1] * len(seeds), random, prose)
    first = (*first[:3], np.zeros(len(seeds), bool))
    every = lambda f: f(*first) + total(f)

    def moments(x: np.ndarray, y: np.ndarray, n: np.ndarray, held: np.ndarray) -> np.ndarray:
        return np.concatenate(([n[~held].sum(), (n * y)[~held].sum(), n[held].sum(), (n * y)[held].sum()], n @ x, n @ (x * x)))

    sums = every(moments)
    k = len(NAMES)
    mean = sums[4 : 4 + k] / (sums[0] + sums[2])
    scale = np.maximum(np.sqrt(np.maximum(sums[4 + k :] / (sums[0] + sums[2]) - mean**2, 0.0)), 1e-3)
    share = sums[1] / sums[0]
    one, none = 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)

    def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.column_stack([(x - mean) / scale, np.ones(len(x))])[~held], y[~held], (n * np.where(y == 1, one, none))[~held]

    w = _newton(every, fit, k + 1, sums[0], 1e-2)
    apart = bool(sums[2] > 50 and 0 < sums[3] < sums[2])

    def calibrate(x: np.ndarray, y: np.ndarray, n: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z, weight, on = np.column_stack([(x - mean) / scale, np.ones(len(x))]) @ w, n * np.where(y == 1, one, none), held == apart
        return np.column_stack([z, np.ones(len(z))])[on], y[on], weight[on]

    slope, shift = _newton(every, calibrate, 2, sums[2] if apart else sums[0], 1e-3)
    return Model(random, prose, mean, scale, w, float(max(slope, 0.1)), float(shift))


def _newton(every: Callable, rows: Callable, k: int, size: float, ridge: float) -> np.ndarray:
    """Weighted logistic regression by Newton steps; rows gives a part's design, labels and weights, size is that of all."""
    w = np.zeros(k)
    for _ in range(25):

        def slopes(*part: np.ndarray) -> np.ndarray:
            x, y, weight = rows(*part)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))  # noqa: B023
            return np.concatenate((x.T @ (weight * (y - p)), ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()))

        sums = every(slopes) / size
        step = np.linalg.solve(sums[k:].reshape(k, k) + ridge * np.eye(k), sums[:k] - ridge * w)
        w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample(df: DataFrame) -> list[tuple[str, str]]:
    """About SAMPLE_FILES files of each table: blocks of neighbouring ids in the order of a hash. Only ids are read to choose
    the blocks, and their ranges reach the scan as a filter, so the texts of other files are left on disk."""
    block = F.expr(f"file_id div {SAMPLE_BLOCK}")
    out = []
    for src, part in ((s, df.where(F.col("src") == s)) for s in ("py_files", "train_general_reasoner")):
        sizes = part.where("file_id is not null").groupBy(block.alias("b")).count().orderBy(F.xxhash64("b"), "b").limit(SAMPLE_FILES).collect()
        chosen, got = [], 0
        for b, n in sizes:
            if got < SAMPLE_FILES:
                chosen.append(b)
                got += n
        if chosen:
            inside = reduce(or_, (F.col("file_id").between(b * SAMPLE_BLOCK, b * SAMPLE_BLOCK + SAMPLE_BLOCK - 1) for b in sorted(chosen)))
            rows = part.where(inside & F.col("text").isNotNull()).select("file_id", "path", "text").orderBy("file_id", "path").collect()
            out += [(p or "", t) for _, p, t in rows if t][: 2 * SAMPLE_FILES]  # ids may repeat
    return out


def found_in(texts: list[str | None], paths: list[str | None], model: Model) -> list[list[Candidate]]:
    """The credentials of each text in order of place; the candidates of all texts are scored together."""
    cands = [candidates(t) if t else [] for t in texts]
    scores = model.score([c for part in cands for c in part], [p or "" for p, part in zip(paths, cands) for _ in part])
    out, k = [], 0
    for part in cands:
        out.append(sorted((c for c, s in zip(part, scores[k : k + len(part)]) if s >= THRESHOLD and MARK not in c.value), key=lambda c: c.start))
        k += len(part)
    return out


def _parts(batches: Iterator[pa.RecordBatch], column: int = 3) -> Iterator[pa.RecordBatch]:
    """Slices of about PART characters of a column."""
    for b in batches:
        sizes = np.cumsum([len(t or "") for t in b.column(column).to_pylist()])
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART, "right")))
            yield b.slice(at, stop - at)
            at = stop


def redact(text: str, found: list[Candidate]) -> str:
    """The text with each credential replaced: letters only, within the same quotes, so the code still parses."""
    out, at = [], 0
    for c in found:
        out.append(text[at : c.start])
        raw = text[c.start : c.end]
        if c.kind == "pem":
            head, tail = _PEM.match(raw)[0], _PEM_END.search(raw)
            gap = "\\n" if "\\n" in raw else "\r\n" if "\r\n" in raw else "\n"
            out.append(head + gap + MARK + gap + tail[0] if tail else head)
        elif c.kind == "pieces":
            marks = iter([MARK])
            out.append(_PIECE.sub(lambda m: m[1] + next(marks, "") + m[1], raw))  # noqa: B023
        else:
            out.append(MARK)
        at = c.end
    return "".join(out) + text[at:]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, file_id, path, text of both tables."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    a = read("py_files").select(F.lit("py_files").alias("src"), F.col("sample_id").alias("file_id"), F.col("file_path").alias("path"), F.col("code_content").alias("text"))
    b = read("train_general_reasoner").select(F.lit("train_general_reasoner").alias("src"), F.col("launch_id").alias("file_id"), F.col("file_path").alias("path"), F.col("script_text").alias("text"))
    return a.unionByName(b)


LISTED = "src string, file_id long, line_no long, kind string, name string, value string, about string, place string, label int, step int, n long"


def listed(df: DataFrame, loose: bool = False) -> DataFrame:
    """Every candidate of every text: its line_no (from 1, lines end at \\n), kind, name and value, what the features take name and
    path for, and its weak label or null. loose: also the counts of steps in all words of the texts, as rows of step and n.

    df: src, file_id, path, text; extra columns are left out.
    """
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int32(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in LISTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_STATES * _STATES)
        for b in _parts(batches):
            rows, words = [], []
            for s, i, path, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                if not text:
                    continue
                place, line, at = _PLACES[_path_flags(path or "")], 1, 0
                for c in sorted(candidates(text), key=lambda c: c.start):
                    line += text.count("\n", at, c.start)
                    at = c.start
                    rows.append((s, i, line, c.kind, c.name, c.value, _ABOUT[_name_flags(c.name)], place, weak_label(c) if loose else None, None, None))
                if loose:
                    words += _LOOSE.findall(text)
            total += steps(words)
            columns = list(zip(*rows)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        if loose:
            counts = _step_rows(total, 0)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(counts.num_rows, t) for t in types[:9]), counts.column(1), counts.column(2)], names)

    return df.select("src", "file_id", "path", "text").mapInArrow(run, LISTED)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """src, file_id, line_no, kind, name of the credentials among the candidates that `listed` gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 5):
            kinds, values, about, places = (b.column(k).to_pylist() for k in (3, 5, 6, 7))
            sure = model.score([Candidate(0, 0, v, a, k) for v, a, k in zip(values, about, kinds)], places) >= THRESHOLD
            keep = [x and MARK not in v for x, v in zip(sure.tolist(), values)]
            yield b.select(["src", "file_id", "line_no", "kind", "name"]).filter(pa.array(keep, pa.bool_()))

    columns = ["src", "file_id", "line_no", "kind", "name", "value", "about", "place"]
    return rows.where("kind is not null").select(columns).mapInArrow(run, "src string, file_id long, line_no long, kind string, name string")


def find(df: DataFrame, model: Model) -> DataFrame:
    """src, file_id, line_no (from 1, lines end at \\n), kind, name of each credential. Null and empty texts have none.

    df: src, file_id, path, text; extra columns are left out. Repeated rows give repeated results.
    """
    return scored(listed(df), model)


def redacted(df: DataFrame, model: Model) -> DataFrame:
    """src, file_id, text with credentials replaced; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            texts = b.column(3).to_pylist()
            out = [redact(t, found) if t else t for t, found in zip(texts, found_in(texts, b.column(2).to_pylist(), model))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["src", "file_id", "text"])

    return df.select("src", "file_id", "path", "text").mapInArrow(run, "src string, file_id long, text string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which a credential starts, in source files and launch files."""
    rows = written(listed(files(spark, sf_dir), loose=True), "candidates")
    return scored(rows, trained(rows)).select("src", "file_id", "line_no").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its credentials replaced."""
    every = files(spark, sf_dir)
    rows = written(listed(every, loose=True), "candidates")
    model = trained(rows)
    removed(rows)
    return redacted(every, model)
