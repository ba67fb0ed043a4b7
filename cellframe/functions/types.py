"""Table type names and Spark types, both ways."""

from __future__ import annotations

from pyspark.sql import types as T

_RE_IM = lambda t: T.StructType([T.StructField("re", t), T.StructField("im", t)])
COMPLEX64, COMPLEX128 = _RE_IM(T.FloatType()), _RE_IM(T.DoubleType())

#: Table type names by Spark type.
NAMES = [
    (T.BooleanType(), ("BOOL", "BOOLEAN")),
    (T.ShortType(), ("BYTE", "UCHAR", "SMALLINT", "SHORT")),
    (T.IntegerType(), ("USMALLINT", "USHORT", "INT", "INTEGER")),
    (T.LongType(), ("UINTEGER", "UINT")),
    (T.FloatType(), ("FLOAT",)),
    (T.DoubleType(), ("DOUBLE",)),
    (COMPLEX64, ("FCOMPLEX", "COMPLEX")),
    (COMPLEX128, ("DCOMPLEX",)),
    (T.StringType(), ("STRING",)),
]
_BY_NAME = {name: kind for kind, names in NAMES for name in names}
#: The name that a Spark type is stored under (the widest that it stands for).
_PREFERRED = [(T.BooleanType(), "BOOLEAN"), (T.ShortType(), "SHORT"), (T.IntegerType(), "INT"), (T.LongType(), "UINT"),
              (T.FloatType(), "FLOAT"), (T.DoubleType(), "DOUBLE"), (COMPLEX64, "COMPLEX"), (COMPLEX128, "DCOMPLEX"),
              (T.StringType(), "STRING")]


def spark_type(name: str) -> T.DataType:
    try:
        return _BY_NAME[name.upper()]
    except KeyError:
        raise ValueError(f"{name} is no table type; known are {', '.join(sorted(_BY_NAME))}") from None


def element_type(kind: T.DataType) -> T.DataType:
    """The scalar type of a cell, below all array levels."""
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind


def depth(kind: T.DataType) -> int:
    n = 0
    while isinstance(kind, T.ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def nested(kind: T.DataType, ndim: int) -> T.DataType:
    for _ in range(ndim):
        kind = T.ArrayType(kind)
    return kind


def is_complex(kind: T.DataType) -> bool:
    kind = element_type(kind)
    return isinstance(kind, T.StructType) and kind.fieldNames() == ["re", "im"]


def table_type(kind: T.DataType) -> str:
    kind = element_type(kind)
    shape = lambda k: k.simpleString()
    for known, name in _PREFERRED:
        if shape(known) == shape(kind):
            return name
    raise ValueError(f"{kind.simpleString()} cannot be stored in a table")
