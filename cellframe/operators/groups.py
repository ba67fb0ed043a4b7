"""Groups of rows by key columns, in the order in which they first appear."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ROWID, chunked, group_chunks, numbered, positions

ROW = "__row__"


def group_list(df: DataFrame, group_cols: Sequence[str], rowid: str = ROWID) -> DataFrame:
    """One row a group: keys, n_rows, first_row and group_id (0, 1, ... by first row)."""
    found = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_rows"), F.min(rowid).alias("first_row"))
    return numbered(found, ["first_row"], "group_id")


def gathered(df: DataFrame, group_cols: Sequence[str], index_cols: Sequence[str], rowid: str = ROWID) -> DataFrame:
    """Keys, first_row, n_rows and the ROWIDs of each group in index order (groups must fit a task)."""
    order = F.array_sort(F.collect_list(F.struct(*index_cols, F.col(rowid).alias("__rowid"))))
    return df.groupBy(*group_cols).agg(F.min(rowid).alias("first_row"), F.count(F.lit(1)).alias("n_rows"), order.alias("o")).select(
        *group_cols, "first_row", "n_rows", F.col("o.__rowid").alias("rows"))


def dense_ids(df: DataFrame, key: str, rowid: str = ROWID, start: int = 0) -> DataFrame:
    """Each distinct key with an id by first appearance."""
    return group_list(df, [key], rowid).select(key, (F.col("group_id") + start).alias("id"))


class Variable:
    """A named column's dims (the first is the row), expression and attributes, over a partition's rows."""

    def __init__(self, dims: Sequence[str], data, attrs: dict | None = None, encoding: dict | None = None, fastpath: bool = False):
        self.dims, self.data, self.attrs, self.encoding = tuple([dims] if isinstance(dims, str) else dims), data, dict(attrs or {}), dict(encoding or {})
        self.part: Partition | None = None

    @property
    def dtype(self):
        return self.part.df.select(self.data).schema[0].dataType

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def values(self) -> list:
        """All cells, on the driver."""
        return [r[0] for r in self.part.df.select(self.data).collect()]

    @property
    def chunks(self):
        return tuple(self.part.chunks.get(d) for d in self.dims) if self.part.chunks else None

    @property
    def shape(self) -> tuple:
        """Rows, and the extents behind them where all cells have the same (else None)."""
        cell, out = self.part.df.select(self.data.alias("c")), [F.count(F.lit(1))]
        at = F.col("c")
        for _ in self.dims[1:]:
            out += [F.when(F.min(F.size(at)) == F.max(F.size(at)), F.min(F.size(at)))]
            at = F.get(at, F.lit(0))
        return tuple(cell.agg(*out).first())


def variable(args) -> Variable:
    """A Variable from itself or from a tuple (dims, data[, attrs[, encoding[, fastpath]]])."""
    if isinstance(args, Variable):
        return args
    if not isinstance(args, tuple):
        raise TypeError(f"a variable is a tuple, not {type(args).__name__}")
    if not 2 <= len(args) <= 5:
        raise TypeError("a variable is a tuple of 2 to 5: (dims, data[, attrs[, encoding[, fastpath]]])")
    return Variable(*args)


class Partition:
    """One group: its rows, its key values as attributes, and payload columns without them."""

    def __init__(self, df: DataFrame, attrs: dict, coords: Sequence[str] = (ROWID,), chunks: dict | None = None, dims: dict | None = None):
        self.df, self.attrs, self.chunks, self.dims = df, dict(attrs), dict(chunks or {}), dict(dims or {})
        self.coords = [c for c in coords if c in df.columns]

    def _with(self, df: DataFrame | None = None, **more) -> Partition:
        kept = {"attrs": self.attrs, "coords": self.coords, "chunks": self.chunks, "dims": self.dims} | more
        return Partition(self.df if df is None else df, **kept)

    def variable(self, name: str) -> Variable:
        """A column as a Variable: its dims as they were assigned, else row and NAME-1, NAME-2, ..."""
        kind, n = self.df.schema[name].dataType, 0
        while kind.typeName() == "array":
            kind, n = kind.elementType, n + 1
        out = Variable(self.dims.get(name, ("row", *[f"{name}-{i + 1}" for i in range(n)])), F.col(name))
        out.part = self
        return out

    def chunked(self, index_cols: Sequence[str] = (), rowid: str = ROWID) -> DataFrame:
        """The rows with the number of the row chunk that each is in, by `chunks`."""
        ends, total = [], 0
        for n in self.chunks["row"]:
            total += n
            ends.append(total)
        if len(set(self.chunks["row"][:-1])) <= 1 and ends:
            return chunked(self.df, self.chunks["row"][0], index_cols, rowid=rowid)
        at = positions(self.df, index_cols, rowid=rowid)
        return at.withColumn("chunk", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("position"))).cast("long"))

    @property
    def data_vars(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.coords]

    def __getitem__(self, name: str):
        if name in self.data_vars or name in self.coords:
            return self.df[name]
        if name in self.attrs:
            return self.attrs[name]
        raise KeyError(name)

    def __getattr__(self, name: str):
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def assign(self, **columns) -> Partition:
        given = {k: variable(v) if isinstance(v, tuple | Variable) else v for k, v in columns.items()}
        dims = self.dims | {k: v.dims for k, v in given.items() if isinstance(v, Variable)}
        plain = {k: v.data if isinstance(v, Variable) else v for k, v in given.items()}
        return self._with(self.df.withColumns({k: v if hasattr(v, "alias") else F.lit(v) for k, v in plain.items()}), dims=dims)

    def assign_coords(self, **columns) -> Partition:
        return self._with(self.df.drop(*self.coords).withColumns(columns), coords=list(columns))

    def assign_attrs(self, **attrs) -> Partition:
        return self._with(attrs=self.attrs | attrs)

    def drop_vars(self, names: str | Sequence[str], errors: str = "raise") -> Partition:
        names = [names] if isinstance(names, str) else list(names)
        if errors not in ("raise", "ignore"):
            raise ValueError("errors is 'raise' or 'ignore'")
        missing = [n for n in names if n not in self.df.columns]
        if missing and errors == "raise":
            raise ValueError(f"{', '.join(missing)} cannot be found")
        return self._with(self.df.drop(*names))

    def rename(self, names: dict[str, str]) -> Partition:
        return self._with(self.df.withColumnsRenamed(names), coords=[names.get(c, c) for c in self.coords])

    def with_constants(self) -> DataFrame:
        """The rows with the attributes of the key as full columns again."""
        return self.df.withColumns({k: F.lit(v) for k, v in self.attrs.items() if not k.startswith("__")})

    def persist(self) -> Partition:
        return self._with(self.df.persist())

    def compute(self):
        return self.df.toPandas()

    def equals(self, other: Partition) -> bool:
        same = self.attrs == other.attrs and sorted(self.df.columns) == sorted(other.df.columns)
        mine = self.df.select(*sorted(self.df.columns)) if same else None
        return same and mine.exceptAll(other.df.select(*mine.columns)).isEmpty() and other.df.select(*mine.columns).exceptAll(mine).isEmpty()


#: The most groups or rows that the list view shows.
MOST = 10_000


def _listed(df: DataFrame, most: int) -> list:
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"there are more than {most} groups: work on the DataFrame, grouped by its keys, instead of a list")
    return found


def keyed(group_cols: Sequence[str], row) -> Column:
    """The condition for a group's rows; null keys are equal."""
    out = F.lit(True)
    for c in group_cols:
        out = out & F.col(c).eqNullSafe(F.lit(row[c]))
    return out


def partitions(df: DataFrame, group_cols: Sequence[str], index_cols: Sequence[str] = (), rowid: str = ROWID, chunks: None | dict | Sequence[dict] = None,
               most: int = MOST) -> list[Partition]:
    """The list view: one Partition a group (or a row, for ["__row__"]), lazily filtered from one DataFrame.

    Keys and counts of `most` groups at most come to the driver; more are refused.  `chunks` has the chunk sizes of
    each group ({"row": ...} and other dimensions), the last for all further groups."""
    specs = [chunks] if isinstance(chunks, dict) else list(chunks or [])
    sizes = lambda i, n: specs[min(i, len(specs) - 1)] | {"row": group_chunks(specs, [0] * i + [n])[i]} if specs else {}
    if ROW in group_cols:
        if list(group_cols) != [ROW]:
            raise ValueError(f"{ROW} stands alone")
        ids = [r[0] for r in _listed(df.orderBy(*index_cols, rowid).select(rowid), most)]
        return [Partition(df.where(F.col(rowid) == i), {ROW: i}, chunks={"row": (1,)} if specs else None) for i in ids]
    if not group_cols:
        return [Partition(df.orderBy(*index_cols, rowid), {}, chunks=sizes(0, df.count()) if specs else None)]
    out = []
    found = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_rows"), F.min(rowid).alias("first_row"))
    for n, row in enumerate(sorted(_listed(found, most), key=lambda r: r["first_row"])):
        attrs = {c: row[c] for c in group_cols}
        attrs["__partition_schema__"] = tuple((c, df.schema[c].dataType.simpleString()) for c in group_cols)
        out.append(Partition(df.where(keyed(group_cols, row)).orderBy(*index_cols, rowid).drop(*group_cols), attrs, chunks=sizes(n, row["n_rows"])))
    return out


def concat(parts: Sequence[Partition]) -> DataFrame:
    """All partitions' rows with their keys as columns."""
    def union(it: Iterator[DataFrame]) -> DataFrame:
        out = next(it)
        for df in it:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    return union(p.with_constants() for p in parts)
