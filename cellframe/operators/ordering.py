"""Row identity and order: sorted positions, chunks, runs of consecutive rows, overlap of intervals."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWID = "ROWID"


class GroupChunkingError(ValueError):
    """Chunks that do not add up to a group's rows."""


def positions(df: DataFrame, index_cols: Sequence[str], group_cols: Sequence[str] = (), rowid: str = ROWID, out: str = "position") -> DataFrame:
    """0-based position of each row in its group (or the table), ascending by index columns, ties by ROWID.

    Without groups the order is global: the order columns alone are range-partitioned, counted and offset, and the
    positions come back by a join on ROWID, which has to be unique."""
    order = [F.col(c) for c in (*index_cols, rowid)]
    if group_cols:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order)) - 1)
    keys = df.select(*dict.fromkeys((*index_cols, rowid)))
    return df.join(_ranked(keys, order, out).select(rowid, out), rowid)


def _ranked(keys: DataFrame, order: Sequence, out: str) -> DataFrame:
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id())
    ranked = frozen(ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1))
    sizes = ranked.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    base = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(
        Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__base")
    return ranked.join(F.broadcast(base), "__p").withColumn(out, F.col("__base") + F.col("__r")).drop("__p", "__base", "__r")


def numbered(table: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """A table without payload (a row a group, say) with the position of each row in a global order."""
    return _ranked(table, [F.col(c) for c in order], out)


def stored_order(df: DataFrame, out: str) -> DataFrame:
    """Rows numbered 0, 1, ... as they stand: partition after partition, each in its own order (files of one scan in
    the order in which Spark reads them).  Sizes of partitions are counted first; one number a partition is kept."""
    marked = frozen(df.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = marked.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    base = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    both = marked.withColumn("__p", part).join(F.broadcast(base), "__p")
    return both.withColumn(out, F.col("__base") + F.col("__m") - F.shiftleft(F.col("__p"), 33)).drop("__p", "__m", "__base")


def frozen(df: DataFrame) -> DataFrame:
    """A checkpoint: partition numbers are read twice and must not be drawn anew."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and all runs on this machine (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_cellframe_core_dir", None)
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = sc._cellframe_core_dir = "file://" + tempfile.mkdtemp(prefix="cellframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def chunk_sizes(spec: int | Sequence[int], rows: int) -> tuple[int, ...]:
    """Block sizes of a chunk specification: a size, -1 for one block, or a tuple that adds up to the rows."""
    if isinstance(spec, int):
        size = rows if spec == -1 else spec
        if size <= 0 and rows:
            raise ValueError(f"{spec} is no chunk size")
        return tuple(min(size, rows - a) for a in range(0, rows, size)) if rows else ()
    if sum(spec) != rows:
        raise GroupChunkingError(f"chunks {tuple(spec)} do not add up to {rows} rows")
    return tuple(spec)


def group_chunks(chunks: Sequence[dict], counts: Sequence[int]) -> list[tuple[int, ...]]:
    """Row chunks of each group; the last specification serves all further groups."""
    if not chunks or any("row" not in c for c in chunks):
        raise ValueError("chunks need a 'row' key")
    return [chunk_sizes(chunks[min(i, len(chunks) - 1)]["row"], n) for i, n in enumerate(counts)]


def chunk_table(spark: SparkSession, chunks: Sequence[dict], counts: Sequence[int]) -> DataFrame:
    """(group_id, chunk, first, last, length) of the row chunks of each group; last is inclusive."""
    made = []
    for group, sizes in enumerate(group_chunks(chunks, counts)):
        made += [(group, i, a, b, b - a + 1) for i, (a, b) in enumerate(extents(sizes, inclusive=True))]
    return spark.createDataFrame(made, "group_id long, chunk long, first long, last long, length long")


def extents(sizes: Sequence[int], inclusive: bool = False) -> list[tuple[int, int]]:
    """(start, end) of blocks that follow each other; an inclusive end is the block's last place."""
    out, start = [], 0
    for n in sizes:
        out.append((start, start + n - (1 if inclusive else 0)))
        start += n
    return out


def chunk_extents(df: DataFrame, size: int, inclusive: bool = False, rowid: str = ROWID) -> DataFrame:
    """(chunk, start, end) of chunks of `size` rows, from the table's count: nothing but the count is gathered."""
    n = df.select(rowid).count()
    chunk = df.sparkSession.range(-(-n // size)).withColumnRenamed("id", "chunk")
    end = F.least((F.col("chunk") + 1) * size, F.lit(n)) - (1 if inclusive else 0)
    return chunk.select("chunk", (F.col("chunk") * size).alias("start"), end.alias("end"))


def rechunked(df: DataFrame, size: int, index_cols: Sequence[str] = (), rowid: str = ROWID) -> DataFrame:
    """Rows dealt anew so that each partition has whole chunks of `size` rows in order, with chunk and position."""
    made = chunked(df, size, index_cols, rowid=rowid)
    return made.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk").sortWithinPartitions("position")


def largest_block(chunks: dict[str, Sequence[int]], variables: dict[str, tuple[tuple[str, ...], int]]) -> int:
    """Bytes of the largest block of any variable (dims, item bytes)."""
    most = 0
    for dims, item in variables.values():
        size = item
        for d in dims:
            size *= max(chunks[d], default=0)
        most = max(most, size)
    return most


def chunked(df: DataFrame, size: int, index_cols: Sequence[str] = (), group_cols: Sequence[str] = (), rowid: str = ROWID) -> DataFrame:
    """Rows with the id of their chunk of `size` rows."""
    return positions(df, index_cols, group_cols, rowid).withColumn("chunk", F.floor(F.col("position") / size))


def ordered_runs(df: DataFrame, index_cols: Sequence[str], rowid: str = ROWID, direction: str = "read") -> DataFrame:
    """Runs of consecutive ROWIDs in storage order with, for reading, the position that each row takes in the order of
    the index columns (the resort index: first, length, resort); for writing the runs alone."""
    if direction not in ("read", "write"):
        raise ValueError("the direction is 'read' or 'write'")
    runs = row_runs(df, rowid=rowid)
    if direction == "write":
        return runs
    at = positions(df.select(*dict.fromkeys((*index_cols, rowid))), index_cols, rowid=rowid).select(F.col(rowid).alias("__id"), "position")
    inside = runs.select("first", "length", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("length") - 1)).alias("__id")).join(at, "__id")
    return inside.groupBy("first", "length").agg(F.array_sort(F.collect_list(F.struct("__id", "position"))).alias("r")).select(
        "first", "length", F.col("r.position").alias("resort"))


def row_runs(df: DataFrame, group_cols: Sequence[str] = (), rowid: str = ROWID, block: int = 1 << 20) -> DataFrame:
    """(first, length) of each maximal run of consecutive ROWIDs.

    Without groups, runs are found in blocks of ROWIDs and joined at the blocks' borders, so that no task
    sorts the whole table."""
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy(rowid)
        runs = df.select(*group_cols, rowid, (F.col(rowid) - F.row_number().over(w)).alias("__run"))
        return runs.groupBy(*group_cols, "__run").agg(F.min(rowid).alias("first"), F.count(F.lit(1)).alias("length")).drop("__run")
    rows = df.select(rowid, F.floor(F.col(rowid) / block).alias("__b"))
    rows = rows.withColumn("__run", F.col(rowid) - F.row_number().over(Window.partitionBy("__b").orderBy(rowid)))
    runs = rows.groupBy("__b", "__run").agg(F.min(rowid).alias("first"), F.count(F.lit(1)).alias("length"))
    touches_next = F.pmod(F.col("first") + F.col("length"), F.lit(block)) == 0
    touches_last = F.pmod(F.col("first"), F.lit(block)) == 0
    inner = runs.where(~touches_next & ~touches_last).select("first", "length")
    edge = runs.where(touches_next | touches_last).select("first", "length")  # two a block at most
    w = Window.orderBy("first")
    new = F.coalesce((F.lag("first").over(w) + F.lag("length").over(w) != F.col("first")).cast("int"), F.lit(1))
    edge = edge.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    edge = edge.groupBy("__run").agg(F.min("first").alias("first"), F.sum("length").alias("length")).drop("__run")
    return inner.unionByName(edge)


def overlaps(requested: Sequence[int], stored: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(requested chunk, stored fragment, start, end) for each overlap; start and end count in the fragment."""
    out, a0 = [], 0
    for i, a in enumerate(requested):
        b0 = 0
        for j, b in enumerate(stored):
            low, high = max(a0, b0), min(a0 + a, b0 + b)
            if low < high:
                out.append((i, j, low - b0, high - b0))
            b0 += b
        a0 += a
    return out


def interval_overlap(left: DataFrame, right: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Overlaps of two tables of intervals (id, start, end), as l_id, r_id, start, end (right's own offsets).

    Intervals are dealt to buckets of `width`, joined by bucket, and counted in the bucket where the overlap begins."""
    span = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    cut = lambda df, p: df.where("end > start").select(
        F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(span).alias("__b"))
    low, high = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    both = cut(left, "l").join(cut(right, "r"), "__b").where((low < high) & (F.floor(low / width) == F.col("__b")))
    return both.select("l_id", "r_id", (low - F.col("r_start")).alias("start"), (high - F.col("r_start")).alias("end"))
