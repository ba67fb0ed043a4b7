"""Conversion between versioned tables and partitioned Parquet, with sub-tables; also as a command."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..functions.literals import parse_chunks
from ..operators.groups import ROW, Partition, partitions
from .parquet import from_parquet, to_parquet
from .store import Store, is_archive_url
from .tables import Table, scan, xds_from_ms, xds_from_table, xds_to_table

#: Sub-tables that are not converted, and those of one row a partition.
SKIPPED, BY_ROW = ("SORTED_TABLE", "SOURCE"), ("SPECTRAL_WINDOW", "POLARIZATION", "FEED", "SOURCE")


def exclusions(texts: Sequence[str]) -> dict[str, set[str]]:
    """"COL", "SUB::COL" and "SUB::*" as columns by table ("" is MAIN)."""
    out: dict[str, set[str]] = {}
    for t in texts:
        sub, mark, column = t.rpartition("::")
        if column == "*" and not sub:
            raise ValueError("all columns of the main table cannot be left out")
        out.setdefault(sub if mark else "", set()).add(column)
    return out


def read_store(spark: SparkSession, path: str, columns=None, **options) -> list[Partition]:
    """The partitions of a table or partitioned store, whichever `path` is; options are those of the reader."""
    if is_archive_url(path):
        raise NotImplementedError("correlator archives are not read here: there is no network")
    if Store(spark, path).assert_type("table", "parquet") == "parquet":
        return from_parquet(spark, path, columns, **options)
    return xds_from_table(spark, path, columns, **options)


def read_main(spark: SparkSession, path: str, columns=None, **options) -> list[Partition]:
    """As `read_store`, but a table is grouped by field and data description where nothing else is said."""
    if Store(spark, path).assert_type("table", "parquet") == "parquet":
        return from_parquet(spark, path, columns, **options)
    return xds_from_ms(spark, path, columns, **options)


def write_store(parts: list[Partition], spark: SparkSession, path: str, fmt: str | None = None, columns="ALL"):
    """Writes partitions as a table or partitioned store; without a format, as what `path` is already."""
    fmt = fmt or Store(spark, path).assert_type("table", "parquet")
    if fmt == "parquet":
        return to_parquet(parts, spark, path, columns)
    if fmt == "table":
        return xds_to_table(parts, spark, path, columns)
    raise NotImplementedError(f"{fmt} stores cannot be written here")


def convert(spark: SparkSession, source: str, target: str, fmt: str = "parquet", exclude: Sequence[str] = (), group_cols: Sequence[str] = (),
            index_cols: Sequence[str] = (), taql_where: str | None = None, force: bool = False, chunks: dict | None = None) -> None:
    """Copies a table with its sub-tables into another format; sub-tables of ragged columns go row by row into Parquet.
    `chunks` bounds the rows of a Parquet file."""
    src, dst = Store(spark, source), Store(spark, target)
    kind, left_out = src.assert_type("table", "parquet"), exclusions(exclude)
    if kind != "table" and (group_cols or index_cols or taql_where):
        raise ValueError("groups, order and predicate are for tables only")
    if dst.exists():
        if not force:
            raise ValueError(f"{target} exists")
        dst.rm()

    def kept(parts: list[Partition], sub: str) -> list[Partition]:
        return [Partition(p.df.drop(*left_out.get(sub, ())), {} if fmt == "table" else {k: v for k, v in p.attrs.items() if k != ROW}) for p in parts]

    if kind == "table":
        main = partitions(scan(spark, source, None, taql_where), group_cols, index_cols)
    else:
        main = from_parquet(spark, source)
        main = [Partition(p.with_constants(), {}) for p in main] if fmt == "table" else main
    if fmt == "parquet":
        to_parquet(kept(main, ""), spark, target, rows_per_file=(chunks or {}).get("row", 0))
    else:
        write_store(kept(main, ""), spark, target, fmt)
    for sub in src.subdirectories():
        if sub in SKIPPED or "*" in left_out.get(sub, ()):
            continue
        where = f"{source}::{sub}"
        if kind == "table" and Store(spark, where).newest() is None:
            continue
        by_row = {"group_cols": [ROW]} if kind == "table" and fmt == "parquet" and sub in BY_ROW else {}
        write_store(kept(read_store(spark, where, **by_row), sub), spark, f"{target}::{sub}", fmt)
    if kind == "table" and fmt == "table":
        Table(spark, target).put_keywords(Table(spark, source).keywords)


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cellframe")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("input")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-x", "--exclude", default="")
    c.add_argument("-g", "--group-columns", default="")
    c.add_argument("-i", "--index-columns", default="")
    c.add_argument("--taql-where", default=None)
    c.add_argument("-f", "--format", default="parquet", choices=("parquet", "table"))
    c.add_argument("-c", "--chunks", default="{row: 10000}", type=parse_chunks)
    c.add_argument("--force", action="store_true")
    f = sub.add_parser("fragments")
    f.add_argument("action", choices=("stat", "rebase"))
    f.add_argument("path")
    f.add_argument("parent", nargs="?")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    names = lambda t: [x.strip() for x in t.split(",") if x.strip()]
    if a.command == "convert":
        convert(spark, a.input, a.output, a.format, names(a.exclude), names(a.group_columns), names(a.index_columns), a.taql_where, a.force, a.chunks)
        return
    from . import fragments

    if a.action == "rebase":
        fragments.rebase(spark, a.path, a.parent)
    for path, columns in fragments.stat(spark, a.path):
        print(path, ", ".join(columns))


if __name__ == "__main__":
    main()
