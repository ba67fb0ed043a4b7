"""Literals: chunk specifications, call strings, natural order, table paths."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_chunks(text: str) -> dict[str, object]:
    """"{row: 1000, chan: (4, 4)}" with bare names as keys."""
    tree = ast.parse(text.strip(), mode="eval").body
    if not isinstance(tree, ast.Dict) or not all(isinstance(k, ast.Name) for k in tree.keys):
        raise SyntaxError(f"{text!r} is no dictionary of names")
    out = {}
    for key, value in zip(tree.keys, tree.values, strict=True):
        found = ast.literal_eval(value)
        if not isinstance(found, int) and not (isinstance(found, tuple) and all(isinstance(x, int) for x in found)):
            raise SyntaxError(f"the chunks of {key.id} are no integers")
        out[key.id] = found
    return out


def parse_call(text: str) -> tuple[str, tuple, dict]:
    """"name(1, 'a', k=2)" as name, arguments and keywords, all literals; a bare name has none."""
    tree = ast.parse(text.strip(), mode="eval").body
    if isinstance(tree, ast.Name):
        return tree.id, (), {}
    if not isinstance(tree, ast.Call) or not isinstance(tree.func, ast.Name):
        raise ValueError(f"{text!r} is no call")
    if any(k.arg is None for k in tree.keywords):
        raise ValueError("keywords have names")
    return tree.func.id, tuple(map(ast.literal_eval, tree.args)), {k.arg: ast.literal_eval(k.value) for k in tree.keywords}


def natural_key(text: str) -> list:
    """A sort key that compares runs of digits as numbers and the rest without case."""
    return [int(x) if x.isdigit() else x.casefold() for x in re.split(r"(\d+)", text)]


def natural_order(column: Column | str) -> Column:
    """The same order as a Column: digits are padded to equal length, the rest is lower-cased."""
    c = F.lower(F.col(column) if isinstance(column, str) else column)
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 32, "0")).otherwise(p)), "")


def split_table(path: str) -> tuple[str, str, str]:
    """(folder, table, sub-table) of "folder/table::SUB"; a path with slashes only has no sub-table."""
    main, mark, sub = path.partition("::")
    main = main.rstrip("/")
    folder, _, name = main.rpartition("/")
    return folder, name, sub.strip("/") if mark else ""
