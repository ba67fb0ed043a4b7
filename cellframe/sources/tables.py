"""Versioned tables: each write makes a new folder of Parquet files and then moves the pointer in a sidecar.

A table has a ROWID column (0, 1, ...), keywords of the table and of columns, and sub-tables in folders of
their own.  Readers see whole versions only; one writer at a time is assumed.
"""

from __future__ import annotations

import json
import math
import uuid
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import where
from ..operators.groups import Partition, partitions
from ..operators.ordering import ROWID
from ..operators.update import add_columns, append, mixed, update
from ..functions.types import is_complex, spark_type
from ..plans.descriptors import build
from ..plans.schemas import column_dims, dims_of
from .store import Store

#: A keyword of this value is deleted.
DELETE = "__delete_keyword__"
DEFAULT_GROUPS = ("FIELD_ID", "DATA_DESC_ID")
ROW_CHUNK = 10_000


def promote(columns: None | str | Sequence[str]) -> list[str]:
    """A list of names from nothing, one name, or several."""
    if columns is None:
        return []
    out = [columns] if isinstance(columns, str) else list(columns)
    if not all(isinstance(c, str) for c in out):
        raise TypeError("columns are named by strings")
    return out


def pick(df: DataFrame, columns: None | str | Sequence[str], rowid: str = ROWID) -> DataFrame:
    """Named columns (none: all) with ROWID; unknown names are ignored with a warning."""
    names = promote(columns)
    for c in names:
        if c not in df.columns:
            warnings.warn(f"{c} is no column and is ignored", stacklevel=2)
    known = [c for c in names if c in df.columns and c != rowid] or [c for c in df.columns if c != rowid]
    return df.select(*([rowid] if rowid in df.columns else []), *known)


def exists(spark: SparkSession, path: str) -> bool:
    return Store(spark, path).is_folder()


class Table:
    """A handle on a versioned table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def _meta(self) -> dict:
        name = self.store.newest()
        text = self.store.read_text(name) if name else None
        return json.loads(text) if text else {"version": None, "keywords": {}, "columns": {}, "schema": None}

    def _put(self, meta: dict) -> None:
        """A new sidecar with the next number: it is written under another name and renamed, and the newest one counts,
        so a crash leaves the one before."""
        now = self.store.newest()
        number = int(now[len("_table-") : -len(".json")]) + 1 if now else 0
        name = f"_writing-{uuid.uuid4().hex[:8]}"
        self.store.write_text(name, json.dumps(meta, sort_keys=True))
        self.store.rename(name, f"_table-{number:010d}.json")

    @property
    def keywords(self) -> dict:
        return self._meta()["keywords"]

    @property
    def column_keywords(self) -> dict:
        return self._meta()["columns"]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._meta()["schema"])

    def df(self) -> DataFrame:
        meta = self._meta()
        if meta["version"] is None:
            raise FileNotFoundError(f"{self.store.url} is no table")
        return self.spark.read.schema(T.StructType.fromJson(meta["schema"])).parquet(f"{self.store.path}/{meta['version']}")

    def save(self, df: DataFrame, keep_metadata: bool = True) -> None:
        """Makes `df` the table's next version."""
        meta = self._meta()
        old = {f["name"]: f.get("metadata", {}) for f in (meta["schema"] or {"fields": []})["fields"]} if keep_metadata else {}
        schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata or old.get(f.name, {})) for f in df.schema])
        version = f"_v-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.store.path}/{version}")
        self._put(meta | {"version": version, "schema": schema.jsonValue()})

    def put_keywords(self, table: dict | None = None, columns: dict[str, dict] | None = None) -> None:
        meta = self._meta()
        merge = lambda old, new: {k: v for k, v in (old | new).items() if v != DELETE}
        meta["keywords"] = merge(meta["keywords"], table or {})
        for c, k in (columns or {}).items():
            meta["columns"][c] = merge(meta["columns"].get(c, {}), k)
        self._put(meta)

    def create(self, df: DataFrame, descriptor: str | None = None, order: Sequence[str] = ()) -> None:
        """A new table of `df`; rows without ROWID are numbered in order; a sub-table is noted in its parent."""
        built = build(self.store.url, T.StructType([f for f in df.schema if f.name != ROWID]), descriptor)
        for f in built:
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
            df = df.withMetadata(f.name, f.metadata) if f.metadata else df
        if ROWID not in df.columns:
            empty = self.spark.createDataFrame([], T.StructType([T.StructField(ROWID, T.LongType()), *df.schema]))
            df = append(empty, df, order)
        self.save(df, keep_metadata=False)
        if self.store.table:
            parent = Table(self.spark, self.store.root)
            parent.put_keywords({self.store.table: f"Table: {self.store.path}"})

    def update(self, changes: DataFrame, columns: Sequence[str] | None = None) -> None:
        self.save(update(self.df(), changes, columns))

    def append(self, rows: DataFrame | Sequence[DataFrame], order: Sequence[str] = ()) -> None:
        before = self.df()
        self.save(append(before, rows, order))

    def add_columns(self, new: DataFrame) -> None:
        self.save(add_columns(self.df(), new))

    def drop_old(self) -> None:
        """Removes all versions and sidecars but the present ones."""
        now, sidecar = self._meta()["version"], self.store.newest()
        for name in self.store.ls():
            if name.startswith("_v-") and name != now or name.startswith("_table-") and name != sidecar:
                self.store.rm(name)


def with_rowid(df: DataFrame, rowid: str = ROWID) -> DataFrame:
    """A stored ROWID, or the row index of a table of one Parquet file."""
    if rowid in df.columns:
        return df
    files = df.inputFiles()
    if len(files) > 1:
        raise ValueError("a table of several files needs a stored ROWID")
    return df.select("*", F.col("_metadata.row_index").alias(rowid))


def scan(spark: SparkSession, path: str, columns=None, taql_where: str | None = None) -> DataFrame:
    """One DataFrame of a table or sub-table: rows that meet the predicate, named columns, ROWID."""
    store = Store(spark, path)
    df = Table(spark, path).df() if store.type() == "table" else with_rowid(spark.read.parquet(store.path))
    return pick(where(df, taql_where), columns)


def xds_from_table(spark: SparkSession, path: str, columns=None, index_cols=None, group_cols=None, taql_where: str | None = None, chunks=None,
                   table_schema=None, table_keywords: bool = False, column_keywords: bool = False, table_proxy: bool = False, **unknown):
    """The list of partitions of a table, and keywords or the handle where they are asked for, in that order.

    `chunks` has the chunk sizes of each partition, the last for all further ones; rows without any are cut at ROW_CHUNK.
    `table_schema` names the dimensions of columns, which partitions carry."""
    if unknown:
        raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
    known = dims_of(path, table_schema)
    groups, index = promote(group_cols), promote(index_cols)
    specs = [{"row": ROW_CHUNK, **c} for c in ([chunks] if isinstance(chunks, dict) else list(chunks))] if chunks else None
    df = scan(spark, path, None, taql_where)
    parts = partitions(df, groups, index, chunks=specs)
    if promote(columns):
        parts = [p._with(pick(p.df, columns)) for p in parts]
    parts = [p._with(dims={f.name: ("row", *column_dims(f, known)) for f in p.df.schema if f.name != ROWID}) for p in parts]
    extra = [Table(spark, path).keywords] * table_keywords + [Table(spark, path).column_keywords] * column_keywords
    extra += [Table(spark, path)] * table_proxy
    return (parts, *extra) if extra else parts


def xds_from_ms(spark: SparkSession, path: str, columns=None, index_cols=None, group_cols=None, **more):
    """As xds_from_table, grouped by FIELD_ID and DATA_DESC_ID where nothing else is said."""
    return xds_from_table(spark, path, columns, index_cols or [], DEFAULT_GROUPS if group_cols is None else group_cols, **more)


def xds_to_table(parts: Partition | Sequence[Partition], spark: SparkSession, path: str, columns="ALL", descriptor: str | None = None,
                 table_keywords: dict | None = None, column_keywords: dict | None = None) -> DataFrame:
    """Writes partitions: those with ROWID update, those without append in their order; a missing table is created and
    missing columns are added.  Gives a summary (partition, columns written, updated) without reading rows again."""
    parts = [parts] if isinstance(parts, Partition) else list(parts)
    table, frames = Table(spark, path), []
    names = sorted({c for p in parts for c in p.data_vars}) if columns == "ALL" else promote(columns)
    for p in parts:
        missing = [c for c in names if c not in p.data_vars]
        if missing and columns != "ALL":
            warnings.warn(f"{', '.join(missing)} is missing in a partition and is skipped there", stacklevel=2)
        keys = [] if columns != "ALL" else list(p.attrs)
        frames.append(p.with_constants().select(*[c for c in (ROWID,) if c in p.df.columns], *[c for c in names if c in p.df.columns],
                                                *[k for k in keys if not k.startswith("__") and k not in p.df.columns]))
    if frames and table.store.newest() is None:
        first, *rest = [f.drop(ROWID) for f in frames]
        table.create(first, descriptor)
        if rest:
            table.append(rest)
    elif frames:
        base = table.df()
        for f in frames:
            for c in f.columns:
                if c not in base.columns:
                    base = base.withColumn(c, F.lit(None).cast(f.schema[c].dataType))
        table.save(mixed(base, frames))
    if table_keywords or column_keywords:
        table.put_keywords(table_keywords, column_keywords)
    rows = [(i, [c for c in f.columns if c != ROWID], ROWID in f.columns) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "partition int, columns array<string>, updated boolean")


def describe(spark: SparkSession, path: str) -> str:
    """The schema of a table as JSON."""
    return Table(spark, path).schema.json()


def dims(spark: SparkSession, path: str, table_schema=None) -> dict[str, tuple[str, ...]]:
    known = dims_of(path, table_schema)
    return {f.name: ("row", *column_dims(f, known)) for f in Table(spark, path).schema}


def from_arrays(spark: SparkSession, columns: dict, rowid: str = ROWID) -> DataFrame:
    """A DataFrame of arrays of any library that numpy or Arrow can read (leading dimension: the row), with ROWID."""
    import numpy as np
    import pyarrow as pa

    def cells(a):
        if isinstance(a, pa.Array | pa.ChunkedArray):
            return a
        a = np.asarray(a.get() if hasattr(a, "get") else a)  # arrays on a device are moved first
        if np.iscomplexobj(a):
            kind = np.float32 if a.dtype == np.complex64 else np.float64
            re, im = (pa.array(np.ascontiguousarray(x).astype(kind).ravel()) for x in (a.real, a.imag))
            flat = pa.StructArray.from_arrays([re, im], ["re", "im"])
        else:
            flat = pa.array(a.ravel().tolist() if a.dtype == object else a.ravel())
        for n in a.shape[:0:-1]:
            flat = pa.FixedSizeListArray.from_arrays(flat, n).cast(pa.list_(flat.type)) if not pa.types.is_struct(flat.type) else pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), flat)
        return flat

    made = {c: cells(a) for c, a in columns.items()}
    size = {len(a) for a in made.values()}
    if len(size) != 1:
        raise ValueError(f"columns have {sorted(size)} rows")
    return spark.createDataFrame(pa.table({rowid: pa.array(range(size.pop()), pa.int64()), **made}))


def blank_table(spark: SparkSession, fields: dict[str, str], rows: int) -> DataFrame:
    """A table of `rows` rows of columns by table type name, each cell the type's zero."""
    zero = {c: F.lit("" if k.upper() == "STRING" else 0).cast(spark_type(k)) if not is_complex(spark_type(k)) else
            F.struct(F.lit(0).alias("re"), F.lit(0).alias("im")).cast(spark_type(k)) for c, k in fields.items()}
    return spark.range(rows).withColumnRenamed("id", ROWID).withColumns(zero)


def write_example(spark: SparkSession, path: str) -> None:
    """The small Measurement Set of the documentation's examples, by a rule: ten rows of two data descriptions (DATA of 16
    channels by 4 correlations, and 32 by 2), 64 antennas, two fields, windows and polarisations."""
    made = [(i, 0, int(i >= 4), 0, float(i), i % 64, (i + 1) % 64) for i in range(10)]
    main = spark.createDataFrame(made, "ROWID long, FIELD_ID int, DATA_DESC_ID int, SCAN_NUMBER int, TIME double, ANTENNA1 int, ANTENNA2 int")
    grid = "transform(sequence(0, {0} - 1), c -> transform(sequence(0, {1} - 1), r -> named_struct('re', cast(ROWID + c as float), 'im', cast(r as float))))"
    main = main.withColumn("DATA", F.expr(f"if(DATA_DESC_ID = 0, {grid.format(16, 4)}, {grid.format(32, 2)})"))
    low, high = 0.856e9, 2 * 0.856e9
    freqs = [[low + i * (high - low) / (n - 1) for i in range(n)] for n in (16, 32)]
    tables = {
        "": main,
        "ANTENNA": spark.range(64).selectExpr("id ROWID", "concat('ANT-', id) NAME", "array(id * 10D, id * 20D, id * 30D) POSITION", "array(0D, 0D, 0D) OFFSET"),
        "POLARIZATION": spark.createDataFrame([(0, 4, [9, 10, 11, 12]), (1, 2, [9, 12])], "ROWID long, NUM_CORR int, CORR_TYPE array<int>"),
        "SPECTRAL_WINDOW": spark.createDataFrame([(i, len(f), f, [(high - low) / len(f)] * len(f), f[len(f) // 2]) for i, f in enumerate(freqs)],
                                                 "ROWID long, NUM_CHAN int, CHAN_FREQ array<double>, CHAN_WIDTH array<double>, REF_FREQUENCY double"),
        "FIELD": spark.createDataFrame([(0, "3C147", 1, math.radians(0), math.radians(60)), (1, "3C147", 1, math.radians(30), math.radians(45))],
                                       "ROWID long, NAME string, NUM_POLY int, ra double, dec double").selectExpr(
            "ROWID", "NAME", "NUM_POLY", *[f"array(array(ra, dec)) {c}" for c in ("PHASE_DIR", "REFERENCE_DIR", "DELAY_DIR")]),
        "DATA_DESCRIPTION": spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "ROWID long, SPECTRAL_WINDOW_ID int, POLARIZATION_ID int"),
    }
    for name, df in tables.items():
        Table(spark, f"{path}::{name}" if name else path).create(df, "table")
