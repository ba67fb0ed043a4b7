"""Stores: paths with sub-tables, options by prefix, format detection, and file operations through Hadoop."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.literals import natural_key, split_table

MAIN = "MAIN"


class UnknownStoreType(ValueError):
    """A folder that holds no known table."""


class InvalidStoreType(ValueError):
    """A store of another type than asked for."""


class Store:
    """A table's folder: `url` or `url::SUB`.  Two stores of equal place and options are equal."""

    #: Reader options by URL prefix; the first prefix that matches serves stores opened without options.
    config: list[tuple[str, dict]] = []

    def __init__(self, spark: SparkSession, url: str, options: dict | None = None):
        main, mark, sub = url.partition("::")
        if sub.strip("/") == MAIN:
            raise ValueError(f"{MAIN} is the name of the main table and no sub-table: leave it out")
        self.spark, self.root, self.table = spark, main.rstrip("/"), sub.strip("/") if mark else ""
        if options is None:
            options = next((o for p, o in self.config if url.startswith(p)), {})
        self.options = dict(options)

    @property
    def path(self) -> str:
        return f"{self.root}/{self.table}" if self.table else self.root

    @property
    def url(self) -> str:
        return f"{self.root}::{self.table}" if self.table else self.root

    def _fs(self, more: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{more}" if more else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, more: str = "") -> bool:
        fs, path = self._fs(more)
        return fs.exists(path)

    def is_folder(self) -> bool:
        fs, path = self._fs()
        return fs.exists(path) and fs.getFileStatus(path).isDirectory()

    def ls(self, more: str = "") -> list[str]:
        fs, path = self._fs(more)
        return sorted((s.getPath().getName() for s in fs.listStatus(path)), key=natural_key) if fs.exists(path) else []

    def walk(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        base, out, it = fs.makeQualified(path).toString(), [], fs.listFiles(path, True)
        while it.hasNext():
            out.append(it.next().getPath().toString()[len(base) + 1 :])
        return sorted(out, key=natural_key)

    def subdirectories(self) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and "=" not in s.getPath().getName()
                      and s.getPath().getName()[0] not in "._" and s.getPath().getName() != MAIN) if fs.exists(path) else []

    def makedirs(self) -> None:
        fs, path = self._fs()
        fs.mkdirs(path)

    def rm(self, more: str = "") -> None:
        fs, path = self._fs(more)
        fs.delete(path, True)

    def rename(self, old: str, new: str) -> None:
        fs, _ = self._fs()
        fs.rename(self._fs(old)[1], self._fs(new)[1])

    def read_text(self, more: str) -> str | None:
        fs, path = self._fs(more)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_text(self, more: str, text: str) -> None:
        fs, path = self._fs(more)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def newest(self) -> str | None:
        """The newest of a table's numbered sidecars."""
        found = [n for n in self.ls() if n.startswith("_table-") and n.endswith(".json")]
        return max(found) if found else None

    def open(self, more: str = "", fmt: str = "binaryFile", **options):
        """A reader's DataFrame on a file or folder of the store, with the store's options."""
        return self.spark.read.options(**{**self.options, **options}).format(fmt).load(f"{self.path}/{more}" if more else self.path)

    def __reduce__(self):
        return _reopened, (self.url, self.options)

    def sub(self, name: str) -> Store:
        return Store(self.spark, f"{self.root}::{name}", self.options)

    def type(self) -> str:
        """"table" (a versioned table of this engine), "parquet" or "zarr"."""
        if self.newest() is not None:
            return "table"
        for name in self.walk():
            if name.endswith(".zgroup"):
                return "zarr"
            if name.endswith(".parquet"):
                return "parquet"
        raise UnknownStoreType(f"{self.path} holds no known table")

    def assert_type(self, *kinds: str) -> str:
        found = self.type()
        if found not in kinds:
            raise InvalidStoreType(f"{self.path} is {found}, not {' or '.join(kinds)}")
        return found

    def __eq__(self, other) -> bool:
        return isinstance(other, Store) and (self.url, self.options) == (other.url, other.options)

    def __hash__(self) -> int:
        return hash((self.url, tuple(sorted(self.options.items()))))


def _reopened(url: str, options: dict) -> Store:
    """A pickled store, on the session of the process that unpickles it."""
    return Store(SparkSession.getActiveSession(), url, options)


def is_archive_url(url: str) -> bool:
    """A correlator archive's address: a host under kat.ac.za and a path that ends in rdb (https needs a token)."""
    from urllib.parse import parse_qs, urlparse

    u = urlparse(url.partition("::")[0])
    token = u.scheme == "http" or u.scheme == "https" and "token" in parse_qs(u.query)
    return bool(token and "kat.ac.za" in (u.hostname or "") and u.path.endswith("rdb"))


__all__ = ["MAIN", "InvalidStoreType", "Store", "UnknownStoreType", "is_archive_url", "split_table"]
