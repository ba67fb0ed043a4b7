"""Partitioned Parquet stores: root/[SUB/]key=value/... with ROWID and a sidecar of schema and attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.groups import MOST, Partition, _listed, keyed
from ..operators.ordering import ROWID, group_chunks
from ..plans.unify import from_json, to_json, unify
from .store import MAIN, Store

SIDECAR = "_schema.json"


def _folder(store: Store) -> Store:
    """The folder of a table: SUB of a sub-table, MAIN of the main one."""
    if store.table:
        return store
    out = Store(store.spark, store.root, store.options)
    out.table = MAIN
    return out


def chosen(df: DataFrame, columns: None | str | Sequence[str], keys: Sequence[str]) -> DataFrame:
    """None or "ALL": all columns; a list: its columns, which have to exist (an empty one: none).  Keys and ROWID stay."""
    if columns is None or isinstance(columns, str) and columns == "ALL":
        return df
    names = [columns] if isinstance(columns, str) else list(columns)
    if unknown := [c for c in names if c not in df.columns]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    kept = [*keys, *([ROWID] if ROWID in df.columns else []), *names]
    return df.select(*dict.fromkeys(kept))


def to_parquet(parts: Sequence[Partition], spark: SparkSession, path: str, columns="ALL", rows_per_file: int = 0,
               attrs: dict | None = None) -> DataFrame:
    """Writes partitions under their keys; without keys they are numbered (DATASET=0, 1, ...).

    Schemas must agree.  Partitions that are written replace what stood under their keys."""
    parts, store = list(parts), _folder(Store(spark, path))
    key_sets = {tuple(k for k in p.attrs if not k.startswith("__")) for p in parts}
    if len(key_sets) > 1:
        raise ValueError("partitions differ in their keys")
    keys = list(key_sets.pop()) if key_sets else []
    frames = [p.with_constants() if keys else p.df.withColumn("DATASET", F.lit(i)) for i, p in enumerate(parts)]
    keys = keys or ["DATASET"]
    frames = [chosen(f, columns, keys) for f in frames]
    schema = unify([f.schema for f in frames])
    out = frames[0].select(*schema.fieldNames())
    for f in frames[1:]:
        out = out.unionByName(f.select(*schema.fieldNames()))
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(store.path)
    store.write_text(SIDECAR, to_json(spark.createDataFrame([], schema), {**(attrs or {}), "partition": keys}))
    return spark.read.schema(schema).parquet(store.path).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))  # from files' footers


def scan_parquet(spark: SparkSession, path: str, columns=None, types: dict[str, str] | None = None) -> tuple[DataFrame, list[str], dict]:
    """A store as one DataFrame, its partition keys and attributes.

    Types come from the sidecar, so keys are never guessed from folder names.  A store that another engine wrote has no
    sidecar: it may have its main table in MAIN or at the root, keys are those of its folders, and their types those
    that `types` names, else what Spark infers.  All folders have to have the same keys."""
    store = _folder(Store(spark, path))
    if not store.exists() and not Store(spark, path).table:
        store = Store(spark, path)
    text = store.read_text(SIDECAR)
    files = [f for f in store.walk() if f.endswith(".parquet") and not any(x[:1] in "._" for x in f.split("/"))]
    found = {tuple(p.split("=", 1)[0] for p in f.split("/")[:-1] if "=" in p) for f in files}
    if text is None:
        if not files:
            raise FileNotFoundError(f"{path} is no partitioned store")
        schema, attrs, keys = None, {}, list(min(found))
    else:
        schema, attrs = from_json(text)
        keys = attrs["partition"]
    if wrong := [f for f in found if list(f) != keys]:
        raise ValueError(f"{path} is partitioned by {keys} and by {list(wrong[0])}")
    if schema is None:
        df = spark.read.option("mergeSchema", "true").parquet(store.path)
        for k, t in (types or {}).items():
            cast = F.col(k).cast("string").try_cast(t)
            if k in keys and not df.where(F.col(k).isNotNull() & cast.isNull()).isEmpty():
                raise ValueError(f"values of {k} are no {t}")
            df = df.withColumn(k, cast)
        attrs = {"partition": keys}
    else:
        df = spark.read.schema(schema).parquet(store.path)
    return chosen(df, columns, keys), keys, attrs


def read_column(spark: SparkSession, path: str, column: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows start to end (without) of one column of a Parquet file, by the files' own row index."""
    df = spark.read.parquet(path).select(column, F.col("_metadata.row_index").alias("row"))
    df = df.where(F.col("row") >= start)
    return df if end is None else df.where(F.col("row") < end)


def from_parquet(spark: SparkSession, path: str, columns=None, chunks: None | dict | Sequence[dict] = None, types: dict[str, str] | None = None,
                 most: int = MOST) -> list[Partition]:
    """The partitions of a store in the order of their keys' values, `most` at most; `chunks` as for tables."""
    df, keys, _ = scan_parquet(spark, path, columns, types)
    if not keys:
        return [Partition(df.orderBy(ROWID) if ROWID in df.columns else df, {})]
    out, specs = [], [chunks] if isinstance(chunks, dict) else list(chunks or [])
    found = _listed(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).orderBy(*keys), most)
    for i, row in enumerate(found):
        part = df.where(keyed(keys, row)).drop(*keys)
        attrs = {} if keys == ["DATASET"] else {k: row[k] for k in keys}
        attrs["__partition_schema__"] = tuple((k, df.schema[k].dataType.simpleString()) for k in keys)
        sizes = {**specs[min(i, len(specs) - 1)], "row": group_chunks(specs, [0] * i + [row["__n"]])[i]} if specs else None
        out.append(Partition(part.orderBy(ROWID) if ROWID in part.columns else part, attrs, chunks=sizes))
    return out


__all__ = ["MAIN", "T", "chosen", "from_parquet", "scan_parquet", "to_parquet"]
