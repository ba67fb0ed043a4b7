"""Expressions over columns: `*`, `/`, `//`, `+`, `-`, unary `-`, numbers and column names, with array semantics.

Division follows IEEE rules (x/0 is an infinity, 0/0 NaN) where Spark's ANSI mode would raise; `//` is the
floor of the quotient; an integer overflow raises (a deliberate difference from wrapping around).
Complex cells are structs (re, im).
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tensors import elementwise
from .types import depth, is_complex


class ColumnExpressionError(ValueError):
    """An expression that cannot be parsed."""


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    none = F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
    # The sign of a zero divisor decides the sign of the infinity; its text shows it.
    sign = F.when(b.cast("string").startswith("-"), -1.0).otherwise(1.0)
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * sign * F.lit(float("inf")))
    return none.when(b == 0, zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def floor_divide(a: Column, b: Column) -> Column:
    found = divide(a, b)
    plain = ~F.isnan(found) & (F.abs(found) < 2.0**53)
    return F.when(plain, F.floor(F.when(plain, found)).cast("double")).otherwise(found)


def _parts(x: Column, complex_: bool) -> tuple[Column, Column]:
    return (x["re"], x["im"]) if complex_ else (x, F.lit(0.0))


def _made(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def cadd(a, b):
    return _made(a["re"] + b["re"], a["im"] + b["im"])


def csub(a, b):
    return _made(a["re"] - b["re"], a["im"] - b["im"])


def cmul(a, b):
    return _made(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def cdiv(a, b):
    size = b["re"] * b["re"] + b["im"] * b["im"]
    return _made(divide(a["re"] * b["re"] + a["im"] * b["im"], size), divide(a["im"] * b["re"] - a["re"] * b["im"], size))


def cneg(a):
    return _made(-a["re"], -a["im"])


def cconj(a):
    return _made(a["re"], -a["im"])


_REAL: dict[type, Callable] = {ast.Mult: lambda a, b: a * b, ast.Div: divide, ast.FloorDiv: floor_divide,
                               ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b}
_COMPLEX: dict[type, Callable] = {ast.Mult: cmul, ast.Div: cdiv, ast.Add: cadd, ast.Sub: csub}


class _Term:
    def __init__(self, column: Column, ndim: int, complex_: bool):
        self.column, self.ndim, self.complex = column, ndim, complex_

    def apply(self, op: type, other: _Term) -> _Term:
        both = self.complex or other.complex
        table = _COMPLEX if both else _REAL
        if op not in table:
            raise ValueError(f"{op.__name__} is not defined for complex numbers")
        fn = table[op]
        if both:
            lift = lambda x, is_c: x if is_c else _made(x.cast("double"), F.lit(0.0))
            fn = lambda a, b, f=table[op]: f(lift(a, self.complex), lift(b, other.complex))
        n = max(self.ndim, other.ndim)
        if self.ndim == other.ndim:
            out = elementwise(fn, n, self.column, other.column)
        elif other.ndim == 0:
            out = elementwise(lambda x: fn(x, other.column), n, self.column)
        elif self.ndim == 0:
            out = elementwise(lambda x: fn(self.column, x), n, other.column)
        else:
            raise ValueError(f"cells of {self.ndim} and {other.ndim} dimensions do not match")
        return _Term(out, n, both)


def _term(node: ast.AST, types: dict[str, T.DataType]) -> _Term:
    if isinstance(node, ast.BinOp):
        if type(node.op) not in _REAL:
            raise ValueError(f"operator {type(node.op).__name__} is not supported")
        return _term(node.left, types).apply(type(node.op), _term(node.right, types))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        x = _term(node.operand, types)
        return _Term(elementwise(cneg if x.complex else lambda v: -v, x.ndim, x.column), x.ndim, x.complex)
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return _Term(F.lit(node.value), 0, False)
    if isinstance(node, ast.Constant) and type(node.value) is complex:
        return _Term(_made(F.lit(node.value.real), F.lit(node.value.imag)), 0, True)
    if isinstance(node, ast.Name):
        if node.id not in types:
            raise ValueError(f"{node.id} is no column")
        return _Term(F.col(node.id), depth(types[node.id]), is_complex(types[node.id]))
    raise ValueError(f"{type(node).__name__} is not supported in expressions")


def column_expression(statement: str, schema: T.StructType) -> Column:
    """The Column that a statement such as "DATA / (MODEL + 1) * 4" stands for."""
    try:
        tree = ast.parse(statement)
    except SyntaxError as e:
        raise ColumnExpressionError(f"{statement!r} is no expression") from e
    if len(tree.body) != 1:
        raise ValueError("an expression is one statement")
    if not isinstance(tree.body[0], ast.Expr):
        raise ValueError("a statement that is no expression")
    return _term(tree.body[0].value, {f.name: f.dataType for f in schema}).column


def data_column_expr(statement: str, tables: DataFrame | list[DataFrame], out: str = "result"):
    """Tables with the expression as column `out`; a list gives a list."""
    if isinstance(tables, list | tuple):
        return [data_column_expr(statement, t, out) for t in tables]
    return tables.withColumn(out, column_expression(statement, tables.schema))
