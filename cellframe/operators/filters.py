"""Predicates and queries in the tables' query language, as Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\|\||&&|==""")
_SQL = {"||": " OR ", "&&": " AND ", "==": " = "}


def translate(predicate: str) -> str:
    """`||`, `&&` and `==` outside string literals as OR, AND and =; all else is Spark SQL."""
    return _TOKEN.sub(lambda m: _SQL.get(m[0], m[0]), predicate)


def where(df: DataFrame, predicate: str | None) -> DataFrame:
    """Rows that meet a predicate, before any grouping."""
    return df if not predicate else df.where(F.expr(translate(predicate)))


def equal_to(columns: Sequence[str], values: Sequence) -> Column:
    """columns[0] = values[0] AND ...; nothing to compare is true."""
    if len(columns) != len(values):
        raise ValueError("as many values as columns are needed")
    out = F.lit(True)
    for c, v in zip(columns, values, strict=True):
        out = out & (F.col(c) == F.lit(v))
    return out


def query(spark: SparkSession, text: str, tables: Sequence[DataFrame] = ()) -> DataFrame:
    """A whole query over tables named $1, $2, ...; SELECT UNIQUE is SELECT DISTINCT, and [SELECT col FROM $n][key] is the
    column's value in the row whose ROWID is the key."""
    text = re.sub(r"\[\s*SELECT\s+(\w+)\s+FROM\s+\$(\d+)\s*\]\[\s*(\w+)\s*\]", r"(SELECT max(__s.\1) FROM $\2 __s WHERE __s.ROWID = \3)", text, flags=re.I)
    text = re.sub(r"\bSELECT\s+UNIQUE\b", "SELECT DISTINCT", translate(text), flags=re.I)
    return spark.sql(re.sub(r"\$(\d+)", r"{t\1}", text), **{f"t{i}": t for i, t in enumerate(tables, 1)})


def clauses(select: Sequence[str] = (), group: Sequence[str] = (), order: Sequence[str] = ()) -> tuple[str, str, str]:
    """SELECT (all columns if none are named), GROUP BY and ORDER BY texts."""
    named = lambda word, cols: f"{word} {', '.join(cols)}" if cols else ""
    return f"SELECT {', '.join(select) or '*'}", named("GROUP BY", group), named("ORDER BY", order)
