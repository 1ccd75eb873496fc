"""Equality of rational expressions by a normal form of our own: quotients of polynomials with exact coefficients.

An expression is a pair of polynomials (numerator, denominator); a polynomial maps monomials, sorted pairs of (symbol,
power), to fractions. Two expressions are equal if the cross products of their pairs are. Roots of numbers are symbols whose
squares are numbers. What is no such expression has no form.
"""

from __future__ import annotations

import re
from fractions import Fraction

Monomial = tuple[tuple[str, int], ...]
Polynomial = dict[Monomial, Fraction]

_TOKEN = re.compile(r"\s*(\d+\.?\d*|\.\d+|\*\*|\^|sqrt|pi|[a-z]|[-+*/()])")
#: Unknowns in an expression, the largest exponent, and terms of a polynomial, beyond which no form is sought.
UNKNOWNS, EXPONENT, TERMS = 2, 64, 4000


class NoForm(ValueError):
    """The text is no rational expression within the bounds."""


def _add(a: Polynomial, b: Polynomial, sign: int = 1) -> Polynomial:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, Fraction(0)) + sign * c
    return {m: c for m, c in out.items() if c}


def _times(a: Polynomial, b: Polynomial) -> Polynomial:
    if len(a) * len(b) > TERMS * 16:
        raise NoForm("too many terms")
    out: Polynomial = {}
    for m, c in a.items():
        for n, d in b.items():
            powers = dict(m)
            value = c * d
            for s, k in n:
                powers[s] = powers.get(s, 0) + k
            for s in [s for s in powers if s.startswith("sqrt:") and powers[s] > 1]:
                value *= Fraction(s[5:]) ** (powers[s] // 2)
                powers[s] %= 2
            key = tuple(sorted((s, k) for s, k in powers.items() if k))
            out[key] = out.get(key, Fraction(0)) + value
    return {m: c for m, c in out.items() if c}


def _number(x: Fraction) -> Polynomial:
    return {(): x} if x else {}


def form(text: str) -> tuple[Polynomial, Polynomial]:
    """Numerator and denominator of an expression; NoForm for other texts."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise NoForm(text[at:])
        tokens.append(m[1])
        at = m.end()
    if len({t for t in tokens if len(t) == 1 and t.isalpha()}) > UNKNOWNS:
        raise NoForm("too many unknowns")
    place = 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def take() -> str:
        nonlocal place
        place += 1
        if place > len(tokens):
            raise NoForm("ends early")
        return tokens[place - 1]

    def total() -> tuple[Polynomial, Polynomial]:
        n, d = product()
        while peek() in ("+", "-"):
            sign = 1 if take() == "+" else -1
            p, q = product()
            n, d = _add(_times(n, q), _times(p, d), sign), _times(d, q)
        return n, d

    def product() -> tuple[Polynomial, Polynomial]:
        n, d = signed()
        while peek() and peek() not in "+-)" and peek() not in ("^", "**"):
            divide = peek() == "/"
            if peek() in ("*", "/"):
                take()
            p, q = signed()
            if divide:
                p, q = q, p
            n, d = _times(n, p), _times(d, q)
            if not d:
                raise NoForm("division by zero")
        return n, d

    def signed() -> tuple[Polynomial, Polynomial]:
        if peek() in ("-", "+"):
            sign = -1 if take() == "-" else 1
            n, d = signed()
            return _times(n, _number(Fraction(sign))), d
        n, d = atom()
        if peek() in ("^", "**"):
            take()
            p, q = signed()
            if set(p) - {()} or set(q) - {()}:
                raise NoForm("an exponent that is no number")
            power = p.get((), Fraction(0)) / q[()]
            if power.denominator != 1 or abs(power) > EXPONENT:
                raise NoForm("an exponent that is no small whole number")
            if power < 0:
                n, d = d, n
            a, b = _number(Fraction(1)), _number(Fraction(1))
            for _ in range(abs(int(power))):
                a, b = _times(a, n), _times(b, d)
            n, d = a, b
            if not d:
                raise NoForm("division by zero")
        return n, d

    def atom() -> tuple[Polynomial, Polynomial]:
        t, one = take(), _number(Fraction(1))
        if t == "(":
            out = total()
            if take() != ")":
                raise NoForm("brackets")
            return out
        if t == "sqrt":
            n, d = atom()
            if set(n) - {()} or set(d) - {()}:
                raise NoForm("the root of an unknown")
            value = n.get((), Fraction(0)) / d[()]
            return root(value), one
        if t[0].isdigit() or t[0] == ".":
            return _number(Fraction(t)), one
        if t.isalpha():
            return {((t, 1),): Fraction(1)}, one
        raise NoForm(t)

    def root(value: Fraction) -> Polynomial:
        if value < 0:
            raise NoForm("the root of a negative number")
        inside, outside = value.numerator * value.denominator, Fraction(1, value.denominator)
        k = 2
        while k * k <= inside and k < 10_000:
            while inside % (k * k) == 0:
                inside //= k * k
                outside *= k
            k += 1
        return {((f"sqrt:{inside}", 1),): outside} if inside > 1 else _number(outside * inside)

    try:
        out = total()
    except (RecursionError, ZeroDivisionError) as e:
        raise NoForm(text) from e
    if place != len(tokens):
        raise NoForm(tokens[place])
    return out


def same(a: str | None, b: str | None) -> bool:
    """Whether both are rational expressions and equal for all values of their unknowns."""
    if not a or not b:
        return False
    try:
        (n, d), (p, q) = form(a), form(b)
        return not _add(_times(n, q), _times(p, d), -1)
    except NoForm:
        return False
