"""Positional look-ups and joins of aligned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ROWID


def by_position(main: DataFrame, sub: DataFrame, key: str, columns: Sequence[str], rowid: str = ROWID, prefix: str = "",
                how: str = "inner") -> DataFrame:
    """`main` with columns of the sub-table row whose number is main's key; Spark broadcasts the sub-table when
    its size is under the session's threshold, and joins by shuffle beyond."""
    taken = sub.select(F.col(rowid).alias("__at"), *[F.col(c).alias(prefix + c) for c in columns])
    return main.join(taken, main[key] == F.col("__at"), how).drop("__at")


def chain(main: DataFrame, *steps: tuple[DataFrame, str, Sequence[str], str]) -> DataFrame:
    """Look-ups one after another: (sub-table, key column, columns, its row number column)."""
    for sub, key, columns, rowid in steps:
        main = by_position(main, sub, key, columns, rowid)
    return main


def attach(main: DataFrame, sub: DataFrame, column: Column, order: str, name: str, most: int = 8 << 20) -> DataFrame:
    """`main` with one whole sub-table column as an array in every row; a column of more than `most` bytes (as text)
    is refused, since the array is repeated.  The one row that holds it is all that is broadcast."""
    size = sub.agg(F.sum(F.octet_length(F.to_json(F.struct(column.alias("v")))))).first()[0] or 0
    if size > most:
        raise ValueError(f"a column of more than {most} bytes is joined by position instead")
    cell = sub.agg(F.array_sort(F.collect_list(F.struct(F.col(order), column.alias("v")))).getField("v").alias(name))
    return main.crossJoin(cell)


def index_of(keys: DataFrame, table: DataFrame, key: str, index: str, default: int = -1) -> DataFrame:
    """`keys` with the index of each key, or the default where the table has none."""
    return keys.join(table.select(key, F.col(index).alias("__i")), key, "left").withColumn(
        index, F.coalesce("__i", F.lit(default))).drop("__i")


class OverlayError(ValueError):
    """Tables that cannot be laid over each other."""


def overlay(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Columns of later tables over those of earlier ones, row by row of the keys; the first has all rows."""
    out = tables[0]
    for t in tables[1:]:
        if missing := [k for k in keys if k not in t.columns]:
            raise OverlayError(f"consolidate failed: {', '.join(missing)} is no column of a later table")
        new = [c for c in t.columns if c not in keys]
        taken = t.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__n_{c}") for c in new], F.lit(True).alias("__has"))
        on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
        joined = out.join(taken, on, "left")
        pick = {c: F.when(F.col("__has"), F.col(f"__n_{c}")).otherwise(out[c]) if c in out.columns else F.col(f"__n_{c}") for c in new}
        out = joined.select(*[pick.pop(c).alias(c) if c in pick else out[c] for c in out.columns], *[v.alias(c) for c, v in pick.items()])
    return out
