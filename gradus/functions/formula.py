"""Score formulas: a small expression language compiled to one Column (no UDF).

Numbers, names with .rating or .bayesian, + - * / % ^, comparisons, and/or/not, ?:, parentheses and functions. Arithmetic follows
IEEE 754: x/0 is an infinity or NaN, log of a negative number is NaN. An empty formula scores nothing (null).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*/%^()<>?:,.]))")
NAN, INF = float("nan"), float("inf")


class FormulaError(ValueError):
    pass


def _div(a: Column, b: Column) -> Column:
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, a).otherwise(a - F.floor(a / F.when(b == 0, F.lit(1.0)).otherwise(b)) * b)


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"),
    "round": lambda x, n=None: F.floor(x + 0.5).cast("double") if n is None else F.floor(x * F.pow(F.lit(10.0), n) + 0.5) / F.pow(F.lit(10.0), n),
    "sqrt": lambda x: F.when(x < 0, F.lit(NAN)).otherwise(F.sqrt(x)), "cbrt": F.cbrt, "exp": F.exp,
    "log": lambda x, b=None: _log(x) if b is None else _div(_log(x), _log(b)), "log10": lambda x: _log(x) / F.log(F.lit(10.0)), "log2": lambda x: _log(x) / F.log(F.lit(2.0)),
    "pow": F.pow, "min": lambda *x: x[0] if len(x) == 1 else F.least(*x), "max": lambda *x: x[0] if len(x) == 1 else F.greatest(*x),
    "mean": lambda *x: sum(x[1:], x[0]) / len(x), "sum": lambda *x: sum(x[1:], x[0]), "sign": F.signum, "mod": _mod,
}


class _Parser:
    def __init__(self, text: str, scope: dict[tuple[str, str], Column]):
        self.scope, self.tokens, at = scope, [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FormulaError(f"unexpected {text[at]!r}")
            self.tokens.append(m.group(1, 2, 3))
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.i = 0

    def peek(self) -> str | None:
        return None if self.i >= len(self.tokens) else next(x for x in self.tokens[self.i] if x is not None)

    def take(self, *want: str) -> str | None:
        if self.peek() in want and (self.tokens[self.i][2] or self.peek() in ("and", "or", "not")):
            self.i += 1
            return next(x for x in self.tokens[self.i - 1] if x is not None)
        return None

    def need(self, want: str) -> None:
        if not self.take(want):
            raise FormulaError(f"{want!r} is missing")

    def ternary(self) -> Column:
        c = self.either()
        if self.take("?"):
            a = self.ternary()
            self.need(":")
            b = self.ternary()
            return F.when(_truth(c), a).otherwise(b)
        return c

    def either(self) -> Column:
        a = self.both()
        while self.take("or"):
            a = _number(_truth(a) | _truth(self.both()))
        return a

    def both(self) -> Column:
        a = self.compare()
        while self.take("and"):
            a = _number(_truth(a) & _truth(self.compare()))
        return a

    def compare(self) -> Column:
        a = self.add()
        while op := self.take("==", "!=", "<", "<=", ">", ">="):
            b = self.add()
            nan = F.isnan(a) | F.isnan(b)
            got = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            a = _number(F.when(nan, F.lit(op == "!=")).otherwise(got))
        return a

    def add(self) -> Column:
        a = self.multiply()
        while op := self.take("+", "-"):
            b = self.multiply()
            a = a + b if op == "+" else a - b
        return a

    def multiply(self) -> Column:
        a = self.unary()
        while op := self.take("*", "/", "%"):
            b = self.unary()
            a = a * b if op == "*" else _div(a, b) if op == "/" else _mod(a, b)
        return a

    def unary(self) -> Column:
        if op := self.take("-", "+", "not"):
            x = self.unary()
            return -x if op == "-" else x if op == "+" else _number(~_truth(x))
        return self.power()

    def power(self) -> Column:
        a = self.primary()
        return F.pow(a, self.unary()) if self.take("^") else a

    def primary(self) -> Column:
        if self.i >= len(self.tokens):
            raise FormulaError("the formula ends too early")
        number, name, op = self.tokens[self.i]
        self.i += 1
        if number:
            return F.lit(float(number))
        if op == "(":
            x = self.ternary()
            self.need(")")
            return x
        if name and self.take("("):
            args = [self.ternary()]
            while self.take(","):
                args.append(self.ternary())
            self.need(")")
            if name not in _FUNCTIONS:
                raise FormulaError(f"no function {name}")
            try:
                return _FUNCTIONS[name](*args)
            except TypeError as e:
                raise FormulaError(str(e)) from e
        if name and self.take("."):
            prop = self.tokens[self.i][1] if self.i < len(self.tokens) else None
            self.i += 1
            if (name, prop) not in self.scope:
                raise FormulaError(f"no value {name}.{prop}")
            return self.scope[name, prop]
        raise FormulaError(f"unexpected {name or op}")


def _truth(x: Column) -> Column:
    return (x != 0) & ~F.isnan(x)


def _number(b: Column) -> Column:
    return F.when(b, F.lit(1.0)).otherwise(F.lit(0.0))


def compile_formula(text: str, scope: dict[tuple[str, str], Column]) -> Column:
    """The formula over a scope {(criterion, 'rating' or 'bayesian'): column}."""
    if not text.strip():
        return F.lit(None).cast("double")
    p = _Parser(text, scope)
    out = p.ternary()
    if p.i != len(p.tokens):
        raise FormulaError(f"unexpected {p.peek()}")
    return out
