"""Numeric expressions: decay, saturation, jitter, status classes, and a calculator for text."""

from __future__ import annotations

import ast
import math
import operator
import sys

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship

ship(sys.modules[__name__])


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c.isNull(), None).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def recency(age_days: Column, half_life_days: float) -> Column:
    """Half-life decay of an age, within 0 and 1; 0 for a half-life that isn't positive."""
    return F.lit(0.0) if half_life_days <= 0 else clamp(F.exp(-age_days / half_life_days * math.log(2)))


def unit_of_text(text: Column) -> Column:
    """Number in [0, 1) that depends on a text alone: its characters folded in base 131, modulo 2^32."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 131 + c).bitwiseAND(0xFFFFFFFF)) / float(1 << 32)


def status_class(status: Column) -> Column:
    """Class of an HTTP status."""
    names = {2: "success", 3: "redirect", 4: "client_error", 5: "server_error"}
    out = F.lit("unknown")
    for k, name in names.items():
        out = F.when((status >= 100 * k) & (status < 100 * k + 100), name).otherwise(out)
    return out


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def calculated(expression: str | None) -> str | None:
    """Value of an arithmetic expression as text; None for what is none, too large or not finite."""

    def value(n: ast.AST):
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            return n.value
        if isinstance(n, ast.UnaryOp) and type(n.op) in _UNARY:
            return _UNARY[type(n.op)](value(n.operand))
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            a, b = value(n.left), value(n.right)
            if isinstance(n.op, ast.Pow) and (abs(b) > 64 or abs(a) > 1e6):
                raise ValueError("too large")
            return _BINARY[type(n.op)](a, b)
        raise ValueError("no arithmetic")

    try:
        v = value(ast.parse((expression or "").strip(), mode="eval").body)
        if isinstance(v, complex) or not math.isfinite(v):
            return None
        return str(int(v)) if float(v).is_integer() else str(v)
    except (ValueError, SyntaxError, ArithmeticError, TypeError, RecursionError, MemoryError):
        return None


@F.pandas_udf(T.StringType())
def calculate(expression: pd.Series) -> pd.Series:
    return expression.map(calculated)
