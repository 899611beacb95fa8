"""A scalar expression of `x`, compiled to one Catalyst column.

The text is never handed to SQL: there `^` is exclusive or, logarithms of negatives are null and divisions by zero
raise. Here values follow IEEE 754 and what isn't finite is found when a result is applied.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Parameters

NAN, INF = float("nan"), float("inf")

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w.])|(?P<name>[A-Za-z_]\w*)|(?P<sign>[-+*/%^(),]))")
#: Binding strength of operators, by the left and the right side.
_BINARY = {"+": (10, 11), "-": (10, 11), "*": (20, 21), "/": (20, 21), "%": (20, 21), "^": (40, 39)}
_UNARY = 30


class ExpressionError(ValueError):
    """The text is not an expression, or goes beyond a limit."""


def _by_zero(d: Column) -> Column:
    """`d`, with 1 in place of zeros, for branches that aren't taken."""
    return F.when(d == 0, F.lit(1.0)).otherwise(d)


def _negative_zero(c: Column) -> Column:
    return c.cast("string") == "-0.0"


def divide(a: Column, b: Column) -> Column:
    sign = F.when(_negative_zero(b), F.lit(-1.0)).otherwise(F.lit(1.0))
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, sign * F.lit(INF)).otherwise(sign * F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(a / _by_zero(b))


def remainder(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(NAN)).otherwise(a % _by_zero(b))


def _log(f: Callable[[Column], Column], at: float) -> Callable[[Column], Column]:
    """A logarithm with its pole at `at`."""
    return lambda x: F.when(F.isnan(x) | (x < at), F.lit(NAN)).when(x == at, F.lit(-INF)).otherwise(f(x))


def _within(f: Callable[[Column], Column], low: float, high: float) -> Callable[[Column], Column]:
    return lambda x: F.when((x < low) | (x > high), F.lit(NAN)).otherwise(f(x))


def _rounding(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Values of 2^52 and more are whole already; Spark's rounding goes through 64-bit integers."""
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 4503599627370496.0), x).otherwise(f(x).cast("double"))


def signum(x: Column) -> Column:
    """1 for +0 and above, -1 for -0 and below."""
    return F.when(F.isnan(x), F.lit(NAN)).when((x > 0) | ((x == 0) & ~_negative_zero(x)), F.lit(1.0)).otherwise(F.lit(-1.0))


def sign(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(NAN)).when(x > 0, F.lit(1.0)).when(x < 0, F.lit(-1.0)).otherwise(F.lit(0.0))


def _fold(pick: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def f(*xs: Column) -> Column:
        out = xs[0]
        for x in xs[1:]:
            out = F.when(F.isnan(out), x).when(F.isnan(x), out).otherwise(pick(out, x))
        return out

    return f


def clamp(x: Column, low: Column, high: Column) -> Column:
    bad = F.isnan(low) | F.isnan(high) | (F.abs(low) == INF) | (F.abs(high) == INF) | (low > high)
    return F.when(bad | F.isnan(x), F.lit(NAN)).otherwise(F.least(F.greatest(x, low), high))


def srgb_encode(x: Column) -> Column:
    return F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def srgb_decode(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def srgb_band(x: Column, low: Column, high: Column, amount: Column) -> Column:
    """`x` brightened between `low` and `high` by a share `amount` of the sRGB curve stretched over the band; NaN
    for bounds and amounts outside 0..1 or out of order."""
    width = high - low
    valid = (low >= 0) & (high <= 1) & (low < high) & (amount >= 0) & (amount <= 1) & ~F.isnan(x) & (F.abs(x) < INF)
    target = low + width * srgb_encode(divide(x - low, width))
    bright = F.least(F.greatest((1 - amount) * x + amount * target, x), high)
    return F.when(~valid | F.isnan(low) | F.isnan(high) | F.isnan(amount), F.lit(NAN)).when((amount == 0) | (x <= low) | (x >= high), x).otherwise(bright)


#: Names, number of arguments (None: one or more) and meaning.
FUNCTIONS: dict[str, tuple[int | None, Callable[..., Column]]] = {
    "sqrt": (1, lambda x: F.when(x < 0, F.lit(NAN)).otherwise(F.sqrt(x))),
    "abs": (1, F.abs),
    "exp": (1, F.exp),
    "ln": (1, _log(F.log, 0.0)),
    "log": (1, _log(F.log, 0.0)),
    "log2": (1, _log(F.log2, 0.0)),
    "log10": (1, _log(F.log10, 0.0)),
    "log1p": (1, _log(F.log1p, -1.0)),
    "exp2": (1, lambda x: F.pow(F.lit(2.0), x)),
    "expm1": (1, F.expm1),
    "sin": (1, F.sin),
    "cos": (1, F.cos),
    "tan": (1, F.tan),
    "asin": (1, _within(F.asin, -1.0, 1.0)),
    "acos": (1, _within(F.acos, -1.0, 1.0)),
    "atan": (1, F.atan),
    "sinh": (1, F.sinh),
    "cosh": (1, F.cosh),
    "tanh": (1, F.tanh),
    "asinh": (1, F.asinh),
    "acosh": (1, _within(F.acosh, 1.0, INF)),
    "atanh": (1, lambda x: F.when(F.abs(x) > 1, F.lit(NAN)).when(x == 1, F.lit(INF)).when(x == -1, F.lit(-INF)).otherwise(F.atanh(F.when(F.abs(x) < 1, x).otherwise(F.lit(0.0))))),
    "floor": (1, _rounding(F.floor)),
    "ceil": (1, _rounding(F.ceil)),
    "round": (1, _rounding(F.round)),
    "signum": (1, signum),
    "sign": (1, sign),
    "atan2": (2, F.atan2),
    "pow": (2, F.pow),
    "hypot": (2, F.hypot),
    "clamp": (3, clamp),
    "min": (None, _fold(F.least)),
    "max": (None, _fold(F.greatest)),
    "srgb": (1, srgb_encode),
    "srgb_band": (4, srgb_band),
}

_OPERATORS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": remainder, "^": F.pow}


@dataclass
class _Reader:
    tokens: list[tuple[str, str]]
    x: Column
    depth: int
    at: int = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        kind, text = self.peek()
        if kind == "end" or (sign is not None and text != sign):
            raise ExpressionError(f"expected {sign or 'a value'} at token {self.at + 1}, found {text or 'the end'}")
        self.at += 1
        return kind, text

    def expression(self, least: int, level: int) -> Column:
        if level > self.depth:
            raise ExpressionError("the expression is nested too deeply")
        kind, text = self.take()
        if kind == "number":
            value = float(text)
            if not math.isfinite(value):
                raise ExpressionError(f"{text} is beyond the range of numbers")
            left = F.lit(value)
        elif kind == "name":
            left = self.named(text, level)
        elif text == "(":
            left = self.expression(0, level + 1)
            self.take(")")
        elif text in "+-":
            inner = self.expression(_UNARY, level + 1)
            left = -inner if text == "-" else inner
        else:
            raise ExpressionError(f"unexpected {text}")
        chain = level
        while (op := self.peek()[1]) in _BINARY and self.peek()[0] == "sign" and _BINARY[op][0] >= least:
            self.take()
            chain += 1
            left = _OPERATORS[op](left, self.expression(_BINARY[op][1], chain if op == "^" else level + 1))
        return left

    def named(self, name: str, level: int) -> Column:
        if self.peek()[1] != "(":
            constants = {"x": self.x, "pi": F.lit(math.pi), "e": F.lit(math.e)}
            if name not in constants:
                raise ExpressionError(f"unknown name {name}")
            return constants[name]
        if name not in FUNCTIONS:
            raise ExpressionError(f"unknown function {name}")
        self.take("(")
        args = []
        if self.peek()[1] != ")":
            args.append(self.expression(0, level + 1))
            while self.peek()[1] == ",":
                self.take(",")
                args.append(self.expression(0, level + 1))
        self.take(")")
        n, f = FUNCTIONS[name]
        if len(args) != n if n is not None else not args:
            raise ExpressionError(f"{name} takes {n if n is not None else 'one or more'} arguments, not {len(args)}")
        return f(*args)


def compiled(text: str, x: Column, p: Parameters = Parameters()) -> Column:
    """The column that `text` means for the double column `x`."""
    if len(text.encode()) > p.expression_max_bytes:
        raise ExpressionError("the expression is too long")
    tokens, at, open_, most = [], 0, 0, 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character {text[at:].strip()[0]!r}")
        kind = m.lastgroup or ""
        tokens.append((kind, m[kind]))
        open_ += (m[kind] == "(") - (m[kind] == ")")
        most, at = max(most, open_), m.end()
    if most > p.expression_max_parentheses:
        raise ExpressionError("too many open parentheses")
    reader = _Reader(tokens, x.cast("double"), p.expression_max_depth)
    out = reader.expression(0, 1)
    if reader.peek()[0] != "end":
        raise ExpressionError(f"unexpected {reader.peek()[1]} after the expression")
    return out


def tone_bands(bands: list[tuple[float, float, float]]) -> str:
    """The expression for sorted bands (low, high, amount) that don't overlap."""
    out = "x"
    for low, high, amount in sorted(bands):
        if not 0 <= low < high <= 1:
            raise ExpressionError("a band lies within 0..1, its low end first")
        out = f"srgb_band({out},{low!r},{high!r},{amount!r})"
    ends = sorted((lo, hi) for lo, hi, _ in bands)
    if any(a[1] > b[0] for a, b in zip(ends, ends[1:], strict=False)):
        raise ExpressionError("bands overlap")
    return out


def finite(y: Column) -> Column:
    """`y`, or an error if it isn't finite."""
    bad = y.isNull() | F.isnan(y) | (F.abs(y) == INF)
    return F.when(bad, F.raise_error(F.lit("the function gives a non-finite value")).cast("double")).otherwise(y)


def clipped(y: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), y))


def wrapped(y: Column) -> Column:
    """Values within 0..1 as they are, others modulo 1 (a tiny negative gives 1)."""
    r = y % F.lit(1.0)
    return F.when((y >= 0) & (y <= 1), y).otherwise(F.when(r < 0, r + 1).otherwise(r))


def scaled(y: Column, low: Column, high: Column) -> Column:
    """0 at the smallest and 1 at the largest; halves keep the span of huge values finite."""
    same = F.raise_error(F.lit("a constant function can't be scaled")).cast("double")
    span = high * 0.5 - low * 0.5
    return F.when(high == low, same).otherwise((y * 0.5 - low * 0.5) / _by_zero(span))
