"""Shared pieces: shared-folder tables, shipping of this package, words and their hashes."""

from __future__ import annotations

import ctypes
import hashlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of a row group of intermediate tables, which a writer holds in memory.
GROUP = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_cellframe_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in sorted(os.walk(top)):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    tag = hashlib.sha1(buf.getvalue()).hexdigest()[:12]
    path = os.path.join(tempfile.mkdtemp(prefix="cellframe-"), f"cellframe_{tag}.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    sc._cellframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs
    on this machine (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(sc, "_cellframe_dir", None)
        if base is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            base = sc._cellframe_dir = "file://" + tempfile.mkdtemp(prefix="cellframe-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cellframe-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: later steps start from files, not from lineage.

    `files` is the most files to write, for tables whose rows are known to be few for each partition; it has
    to grow with the rows (see `files_for`)."""
    path = new_path(df.sparkSession, name)
    (df if files is None else df.coalesce(files)).write.option("compression", "zstd").option("parquet.block.size", GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cellframe_path = path
    return out


def files_for(rows: int) -> int:
    """Files for a number of rows: of 32,768 rows each, 200 at most until that makes more than 262,144 rows a file."""
    return max(1, min(-(-rows // (1 << 15)), max(200, rows >> 18)))


def remove(*tables: DataFrame) -> None:
    """Deletes the files of tables from `materialize` that no result reads any more."""
    for df in tables:
        remove_path(df.sparkSession, df._cellframe_path)


def remove_path(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def octets(text: Column | str) -> Column:
    """UTF-8 bytes of a text; null becomes empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


class Memo:
    """A memo of strings to bytes, bounded by bytes: two generations, so that the frequent keys stay.

    `room` is for both generations together; an entry counts its key, its value and what a dictionary takes for it."""

    ENTRY = 190

    def __init__(self, room: int = 64 << 20):
        self.room, self.used, self.new, self.old = room // 2, 0, {}, {}

    def get(self, key: str) -> bytes | None:
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if self.used >= self.room:
            self.old, self.new, self.used = self.new, {}, 0
        self.new[key] = value
        self.used += len(key) + len(value) + self.ENTRY


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the named binary or string column holds about `limit` bytes at most (one row at least).

    Memory that the pieces before have left is given back to the system every 32 MB and at the end."""
    done = 0
    for batch in batches:
        lengths = np.cumsum(_lengths(batch.column(column)))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(lengths, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            done += int(lengths[stop - 1]) - base
            start, base = stop, int(lengths[stop - 1])
            if done >= 32 << 20:
                trim()
                done = 0
    trim()


def trim() -> None:
    """Gives free memory of Arrow's pool and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def gathered(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.RecordBatch]:
    """Joins batches until the named column holds `least` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(_lengths(batch.column(column)).sum())
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
