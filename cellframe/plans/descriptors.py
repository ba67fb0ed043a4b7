"""Table templates: required columns with types and dimensions, looked up by name or call string."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import parse_call
from ..functions.tensors import shape
from ..functions.types import depth, element_type, nested, spark_type, table_type
from .schemas import DIMS, DimensionError, check_sizes, kind

#: Required MAIN columns (name, table type, dimensions behind the row).
MAIN = [("UVW", "DOUBLE", 1), ("FLAG", "BOOLEAN", 2), ("FLAG_CATEGORY", "BOOLEAN", 3), ("WEIGHT", "FLOAT", 1), ("SIGMA", "FLOAT", 1),
        ("ANTENNA1", "INT", 0), ("ANTENNA2", "INT", 0), ("ARRAY_ID", "INT", 0), ("DATA_DESC_ID", "INT", 0), ("EXPOSURE", "DOUBLE", 0),
        ("FEED1", "INT", 0), ("FEED2", "INT", 0), ("FIELD_ID", "INT", 0), ("FLAG_ROW", "BOOLEAN", 0), ("INTERVAL", "DOUBLE", 0),
        ("OBSERVATION_ID", "INT", 0), ("PROCESSOR_ID", "INT", 0), ("SCAN_NUMBER", "INT", 0), ("STATE_ID", "INT", 0),
        ("TIME", "DOUBLE", 0), ("TIME_CENTROID", "DOUBLE", 0)]
BUILDERS: dict[str, Callable[..., T.StructType]] = {}


def builder(name: str):
    def put(fn):
        BUILDERS[name] = fn
        return fn

    return put


def _field(name: str, kind_: str, ndim: int, dims: tuple[str, ...] = ()) -> T.StructField:
    return T.StructField(name, nested(spark_type(kind_), ndim), True, {"dims": list(dims)} if dims else {})


@builder("table")
def table(schema: T.StructType) -> T.StructType:
    return schema


@builder("ms")
def main(schema: T.StructType, fixed: bool = True) -> T.StructType:
    """The given columns and the required ones of MAIN that are missing; dimension names are added.

    With `fixed`, columns whose dimensions all have one known size (see `infer_sizes`) get that shape."""
    dims = {c: list(d) for c, d in DIMS["MS"].items()}
    have = set(schema.fieldNames())
    fields = [T.StructField(f.name, f.dataType, True, {**f.metadata, **({"dims": dims[f.name]} if f.name in dims else {})}) for f in schema]
    for c, k, n in MAIN:
        if c in have:
            if depth(schema[c].dataType) != n:
                raise ValueError(f"{c} has {depth(schema[c].dataType)} dimensions and needs {n}")
        else:
            fields.append(_field(c, k, n, tuple(dims.get(c, ()))))
    out = T.StructType(fields)
    return fixed_columns(out, infer_sizes([out])) if fixed else out


@builder("bitflag_ms")
def flagged(schema: T.StructType, fixed: bool = True) -> T.StructType:
    """MAIN with bit flags."""
    more = [_field("BITFLAG", "INT", 2, ("chan", "corr")), _field("BITFLAG_ROW", "INT", 0)]
    return T.StructType([*main(schema, fixed), *[f for f in more if f.name not in schema.fieldNames()]])


@builder("ms_subtable")
def subtable(schema: T.StructType, name: str = "") -> T.StructType:
    dims = {c: list(d) for c, d in DIMS.get(name, {}).items()}
    return T.StructType([T.StructField(f.name, f.dataType, True, {**f.metadata, **({"dims": dims[f.name]} if f.name in dims else {})}) for f in schema])


def infer_column(name: str, fields: Sequence[T.StructField]) -> dict:
    """What a column of several tables can be stored as: its one type, ndim (-1 where tables differ), and shape where all
    have the same one (field metadata "shape", the extents behind the row)."""
    kinds = {table_type(f.dataType) for f in fields}
    if len(kinds) != 1:
        raise TypeError(f"{name} has the types {', '.join(sorted(kinds))}; a column has one")
    ndims, shapes = {depth(f.dataType) for f in fields}, {tuple(f.metadata.get("shape", ())) for f in fields}
    out = {"valueType": kinds.pop(), "option": 0, "maxlen": 0, "comment": f"{name} column"}
    if len(ndims) > 1:
        warnings.warn(f"{name} has {sorted(ndims)} dimensions in different tables", stacklevel=2)
        return out | {"ndim": -1}
    ndim = ndims.pop()
    if ndim:
        out["ndim"] = ndim
        if len(shapes) == 1 and len(min(shapes)) == ndim:
            out["shape"] = list(shapes.pop())
    return out


def with_shapes(df: DataFrame) -> T.StructType:
    """The schema of `df` with the shape of each array column whose cells all have the same: one pass, one row."""
    found = {f.name: depth(f.dataType) for f in df.schema if depth(f.dataType)}
    wanted = [x for c, n in found.items() for x in (F.min(shape(c, n)).alias(f"lo_{c}"), F.max(shape(c, n)).alias(f"hi_{c}"))]
    row = df.agg(*wanted).first() if wanted else {}
    same = {c: list(row[f"lo_{c}"]) for c in found if row[f"lo_{c}"] is not None and row[f"lo_{c}"] == row[f"hi_{c}"]}
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, **({"shape": same[f.name]} if f.name in same else {})}) for f in df.schema])


def infer_sizes(schemas: Sequence[T.StructType]) -> dict[str, int]:
    """One size for each named dimension over all columns of all tables; none at all, with a warning, where they differ."""
    try:
        return check_sizes({(f.name, i): (tuple(f.metadata["dims"]), tuple(f.metadata["shape"]))
                            for i, s in enumerate(schemas) for f in s if {"dims", "shape"} <= set(f.metadata)})
    except DimensionError as e:
        warnings.warn(f"no fixed shapes: {e}", stacklevel=2)
        return {}


def fixed_columns(schema: T.StructType, sizes: dict[str, int]) -> T.StructType:
    """Array columns whose dims are all in `sizes` with that shape, marked as fixed; strings stay as they are."""
    out = []
    for f in schema:
        dims, more = f.metadata.get("dims", ()), {}
        if depth(f.dataType) and dims and all(d in sizes for d in dims) and not isinstance(element_type(f.dataType), T.StringType):
            more = {"shape": [sizes[d] for d in dims], "fixed": True}
        out.append(T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, **more}))
    return T.StructType(out)


def build(path: str, schema: T.StructType, call: str | None = None) -> T.StructType:
    """The schema of a new table: the builder named by `call` ("ms(fixed=False)"), or by the table's kind."""
    if call is None:
        k = kind(path)
        return main(schema) if k == "MS" else table(schema) if k == "TABLE" else subtable(schema, k)
    name, args, more = parse_call(call)
    if name not in BUILDERS:
        raise ValueError(f"{name} is no builder; known are {', '.join(sorted(BUILDERS))}")
    return BUILDERS[name](schema, *args, **more)


def tile_rows(shape: tuple[int, ...], item: int, goal: int = 1 << 20, least: int = 512) -> int:
    """Rows of a fixed-shape column that fill about `goal` bytes: a hint for row groups."""
    cell = item
    for n in shape:
        cell *= max(1, n)
    rows = least
    while rows * cell < goal:
        rows *= 2
    return rows
