"""Tensor cells as nested arrays: shapes, slices, reductions, gathers, and elementwise functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column | str, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once, however often fn names it."""
    return F.get(F.transform(F.array(_col(value)), fn), F.lit(0))


def shape(cell: Column | str, ndim: int) -> Column:
    """The cell's extents, taken along first elements; null cells have a null shape."""
    cell, out = _col(cell), []
    for _ in range(ndim):
        out.append(F.size(cell))
        cell = F.get(cell, F.lit(0))
    return F.array(*out)


def elementwise(fn: Callable[..., Column], ndim: int, *cells: Column | str) -> Column:
    """fn over equally shaped cells, at the innermost level."""
    cells = [_col(c) for c in cells]
    if ndim == 0:
        return fn(*cells)
    inner = lambda *xs: elementwise(fn, ndim - 1, *xs)
    if len(cells) == 1:
        return F.transform(cells[0], lambda x: inner(x))
    if len(cells) == 2:
        return F.zip_with(cells[0], cells[1], lambda x, y: inner(x, y))
    return F.transform(F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(cells)]),
                       lambda s: inner(*[s.getField(i) for i in range(len(cells))]))


def slab(cell: Column | str, blc: Sequence[int], trc: Sequence[int]) -> Column:
    """The part of a cell between two corners, 0-based, both ends included."""
    cell = _col(cell)
    if len(blc) != len(trc):
        raise ValueError("corners differ in length")
    if not blc:
        return cell
    part = F.slice(cell, blc[0] + 1, trc[0] - blc[0] + 1)
    return part if len(blc) == 1 else F.transform(part, lambda x: slab(x, blc[1:], trc[1:]))


def assign_slab(cell: Column | str, part: Column | str, blc: Sequence[int]) -> Column:
    """The cell with a part written over it from a corner on."""
    cell, part = _col(cell), _col(part)
    inside = lambda i: (i >= blc[0]) & (i < blc[0] + F.size(part))
    new = lambda x, i: F.get(part, i - blc[0])
    if len(blc) == 1:
        return F.transform(cell, lambda x, i: F.when(inside(i), new(x, i)).otherwise(x))
    return F.transform(cell, lambda x, i: F.when(inside(i), assign_slab(x, new(x, i), blc[1:])).otherwise(x))


def total(vector: Column | str) -> Column:
    return F.aggregate(_col(vector), F.lit(0.0), lambda a, x: a + x)


def mean(vector: Column | str) -> Column:
    """The mean of a vector; null for an empty one."""
    vector = _col(vector)
    return F.when(F.size(vector) > 0, total(vector) / F.size(vector))


def axis_mean(matrix: Column | str) -> Column:
    """The mean over the first axis of a matrix, a vector over the second."""
    width = lambda m: F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1)
    one = lambda m, k: F.aggregate(m, F.lit(0.0), lambda a, row: a + F.get(row, k), lambda a: a / F.size(m))
    return bound(matrix, lambda m: F.transform(width(m), lambda k: one(m, k)))


def midpoint(vector: Column | str) -> Column:
    vector = _col(vector)
    return F.get(vector, F.floor(F.size(vector) / 2).cast("int"))


def power(vector: Column | str, exponent: float) -> Column:
    return F.transform(_col(vector), lambda x: F.pow(x, F.lit(exponent)))


def nonzero(vector: Column | str) -> Column:
    return F.transform(_col(vector), lambda x: x != 0)


def gather(vector: Column | str, index: Column | str, default: Column) -> Column:
    """vector[i] for each i of an index; a negative or foreign i gives the default."""
    vector = _col(vector)
    return F.transform(_col(index), lambda i: F.when((i < 0) | (i >= F.size(vector)), default).otherwise(F.get(vector, i)))


def flat(cell: Column | str, ndim: int) -> Column:
    """The elements in C order."""
    cell = _col(cell)
    for _ in range(ndim - 1):
        cell = F.flatten(cell)
    return cell


def shaped(elements: Column | str, sizes: Sequence[int]) -> Column:
    """Elements in C order as nested arrays of the given extents."""
    out, count = _col(elements), 1
    for size in sizes:
        count *= size
    for size in reversed(sizes[1:]):
        count //= size
        out = _rows(out, size, count)
    return out


def _rows(elements: Column, size: int, count: int) -> Column:
    if not count:
        return F.slice(F.array(elements), 1, 0)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.slice(elements, k * size + 1, size))


def pairs_of(complexes: Column | str) -> Column:
    """Complex elements of a vector as [re, im] arrays, the interchange form."""
    return F.transform(_col(complexes), lambda c: F.array(c["re"], c["im"]))


def complex_of(pairs: Column | str) -> Column:
    return F.transform(_col(pairs), lambda p: F.struct(F.get(p, F.lit(0)).alias("re"), F.get(p, F.lit(1)).alias("im")))
