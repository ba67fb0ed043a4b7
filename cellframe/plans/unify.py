"""Schemas of several tables as one, and chunk sizes by memory."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class UnificationError(ValueError):
    """Columns that differ between tables."""


def unify(schemas: Sequence[T.StructType], strict: bool = True) -> T.StructType:
    """All columns in order of first appearance; with `strict` a column has one type, dims and shape in all."""
    found: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema:
            old = found.setdefault(f.name, f)
            facts = lambda x: (x.dataType.simpleString(), x.metadata.get("dims"), x.metadata.get("shape"))
            if strict and facts(old) != facts(f):
                raise UnificationError(f"{f.name} is {facts(old)} in one table and {facts(f)} in another")
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in found.values()])


def describe(schemas: Sequence[T.StructType]) -> list[tuple[str, int, int]]:
    """(column, tables that have it, its different types)."""
    seen: dict[str, list[str]] = {}
    for schema in schemas:
        for f in schema:
            seen.setdefault(f.name, []).append(f.dataType.simpleString())
    return [(c, len(t), len(set(t))) for c, t in seen.items()]


def to_json(df: DataFrame, attrs: dict) -> str:
    return json.dumps({"schema": df.schema.jsonValue(), "attrs": attrs}, sort_keys=True)


def from_json(text: str) -> tuple[T.StructType, dict]:
    found = json.loads(text)
    return T.StructType.fromJson(found["schema"]), found["attrs"]


def drop_dim(schema: T.StructType, dim: str) -> T.StructType:
    """Columns' metadata without a dimension."""
    out = []
    for f in schema:
        dims = f.metadata.get("dims")
        kept = {**f.metadata, "dims": [d for d in dims if d != dim]} if dims else f.metadata
        out.append(T.StructField(f.name, f.dataType, f.nullable, kept))
    return T.StructType(out)


def chunks_by_size(sizes: dict[str, int], variables: dict[str, tuple[tuple[str, ...], int]], most: int = 2**31 - 1,
                   whole: set[str] | None = None, chunks: dict[str, int] | None = None) -> dict[str, int]:
    """One chunk length for each dimension so that no variable's chunk (dims, item bytes) exceeds `most` bytes.

    Dimensions in `whole` are not cut; the rest share what is left evenly, and short ones leave their share to
    the others.  With present `chunks` that already fit, those are kept."""
    whole, out = whole or set(), dict(sizes)

    def volume(of: dict[str, int], dims: tuple[str, ...]) -> int:
        n = 1
        for d in dims:
            n *= of[d]
        return n

    if chunks is not None and all(volume(chunks, dims) * item <= most for dims, item in variables.values()):
        return dict(chunks)
    for name, (dims, item) in variables.items():
        room, free = most // item, [d for d in dims if d not in whole]
        room //= max(1, volume(sizes, tuple(d for d in dims if d in whole)))
        if room < 1:
            raise ValueError(f"{name} cannot be cut to {most} bytes without cutting {sorted(whole)}")
        for k, d in enumerate(sorted(free, key=lambda d: sizes[d])):
            share = max(1, int(room ** (1 / (len(free) - k)) + 1e-9))
            size = min(sizes[d], share)
            out[d] = min(out[d], size)
            room = max(1, room // size)
    return out
