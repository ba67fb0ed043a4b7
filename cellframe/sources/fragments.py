"""Fragments: stores that hold some columns anew and name the store that they change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.groups import Partition
from ..operators.lookup import overlay
from ..operators.ordering import ROWID
from ..plans.unify import from_json, to_json
from .parquet import SIDECAR, _folder, scan_parquet, to_parquet
from .store import Store

PARENT = "parent"


def ancestry(spark: SparkSession, path: str) -> list[str]:
    """The stores that a fragment rests on, the root first and itself last."""
    out, seen = [], set()
    while path:
        if path in seen:
            raise ValueError(f"{path} is its own ancestor")
        seen.add(path)
        text = _folder(Store(spark, path)).read_text(SIDECAR)
        if text is None:
            raise FileNotFoundError(f"{path} is missing")
        out.append(path)
        path = from_json(text)[1].get(PARENT)
    return out[::-1]


def read_fragment(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """The root with all its fragments' columns laid over it, by key and ROWID; the youngest wins."""
    frames, keys = [], None
    for p in ancestry(spark, path):
        df, mine, _ = scan_parquet(spark, p)
        if keys is not None and mine != keys:
            raise ValueError(f"consolidate failed: {p} is partitioned by {mine}, its parent by {keys}")
        frames, keys = [*frames, df], mine
    out = overlay(frames, [*keys, ROWID])
    return out if columns is None else out.select(*keys, ROWID, *[c for c in columns if c in out.columns])


def read_main_fragment(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """The same for a main table: its keys and ROWID are its own already."""
    return read_fragment(spark, path, columns)


def write_fragment(parts: Sequence[Partition], spark: SparkSession, path: str, parent: str, columns="ALL") -> DataFrame:
    """Writes partitions as a fragment of `parent`."""
    if Store(spark, path) == Store(spark, parent):
        raise ValueError("a store is not its own parent")
    ancestry(spark, parent)
    return to_parquet(parts, spark, path, columns, attrs={PARENT: parent})


def stat(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(store, its columns) along the ancestry."""
    return [(p, scan_parquet(spark, p)[0].columns) for p in ancestry(spark, path)]


def rebase(spark: SparkSession, path: str, parent: str) -> None:
    """Names another parent for a fragment."""
    if Store(spark, path) == Store(spark, parent) or path in ancestry(spark, parent):
        raise ValueError("a store is not its own ancestor")
    store = _folder(Store(spark, path))
    schema, attrs = from_json(store.read_text(SIDECAR))
    store.write_text(SIDECAR, to_json(spark.createDataFrame([], schema), attrs | {PARENT: parent}))
