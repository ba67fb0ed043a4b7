"""Updates, appends and new columns: each gives the next version of a table as a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import overlay
from .ordering import ROWID, positions, stored_order


class DuplicateRows(ValueError):
    """An update that has a ROWID twice."""


def update(base: DataFrame, changes: DataFrame, columns: Sequence[str] | None = None, rowid: str = ROWID, check: bool = True) -> DataFrame:
    """The named columns of the rows with the changes' ROWIDs are replaced; all else stays."""
    if check and not changes.groupBy(rowid).count().where("count > 1").isEmpty():
        raise DuplicateRows(f"{rowid} repeats in an update")
    columns = [c for c in (columns or changes.columns) if c != rowid and c in changes.columns]
    return overlay([base, changes.select(rowid, *columns)], [rowid])


class BrokenRows(ValueError):
    """A table whose ROWIDs are not 0, 1, ... and that no rows can be appended to."""


def append(base: DataFrame, rows: Sequence[DataFrame] | DataFrame, order: Sequence[str] = (), rowid: str = ROWID) -> DataFrame:
    """Rows without ROWID are numbered on from the table's last; several tables follow each other in order, and the
    rows of each stand as they are stored, or in the order of columns that are unique together.

    The table's ROWIDs have to be 0 to count - 1, so that each table begins at the row that is the count so far."""
    rows = [rows] if isinstance(rows, DataFrame) else list(rows)
    start, last = base.agg(F.count(F.lit(1)), F.max(rowid)).first() if rowid in base.columns else (0, None)
    if start and last != start - 1:
        raise BrokenRows(f"the table has {start} rows and ends with {rowid} {last}")
    out = base
    for i, df in enumerate(rows):
        df = df.drop(rowid)
        if order:
            numbered = positions(df.withColumn("__tie", F.struct(*order)), (), rowid="__tie").drop("__tie")
        else:
            numbered = stored_order(df, "position")
        out = out.unionByName(numbered.withColumn(rowid, F.col("position") + start).drop("position"), allowMissingColumns=True)
        start += df.count() if i < len(rows) - 1 else 0
    return out


def mixed(base: DataFrame, changes: Sequence[DataFrame], rowid: str = ROWID, order: Sequence[str] = ()) -> DataFrame:
    """Updates (tables with ROWID) first, then appends (tables without), whatever their order in the list."""
    for df in changes:
        if rowid in df.columns:
            base = update(base, df, rowid=rowid)
    news = [df for df in changes if rowid not in df.columns]
    return append(base, news, order, rowid) if news else base


def add_columns(base: DataFrame, new: DataFrame, rowid: str = ROWID) -> DataFrame:
    """Columns that the table has not, joined by ROWID; rows without a value hold null."""
    return overlay([base, new.select(rowid, *[c for c in new.columns if c not in base.columns])], [rowid])


def conform(rows: DataFrame, against: DataFrame, rowid: str = ROWID) -> None:
    """Raises unless both tables have the same ROWIDs."""
    a, b = rows.select(rowid), against.select(rowid)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("ROWID shape and/or chunking does not match that of the columns")
