"""Byte-level BPE by a hierarchical-bitmap rank queue.

The pairs of a pre-token that have a merge rank are queued: each rank has a bucket of linked-list
positions, and a two-level bitmap tells which buckets hold any.  Find-first-set on the bitmap gives the
lowest rank; its positions are merged from left to right; entries whose pair has changed since they were
queued are stale and skipped.  Each merge queues two pairs at most, so a pre-token of n bytes takes
O(n log n) steps at worst, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Parts
from .common import Memo, batch_of, gathered, pieces, read, ship


class Bpe:
    """An encoder and decoder for ranks (bytes to id, of any size) and a pre-tokenising pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int = 64 << 20):
        self.ranks, self.vocabulary = ranks, {i: b for b, i in ranks.items()}
        # The bitmap's two levels: groups of 256 ranks, and as many groups as the ranks need.
        self.bits = [1 << i for i in range(max(256, (max(ranks.values(), default=0) >> 8) + 1))]
        self.memo = Memo(room)  # of pre-tokens
        self.parts = Parts(regex.compile(pattern).findall, self._solve)

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, pattern)

    def encode_bytes(self, token: bytes) -> list[int]:
        """The ids of one pre-token.

        `low[g]` has a bit for each rank of group g that has a bucket, `top` a bit for each group that has any;
        `pair[i]` is the rank of the pair that begins at byte i, so an entry is stale if it differs.
        """
        ranks = self.ranks
        whole = ranks.get(token)
        if whole is not None:
            return [whole]
        rank_of, bit_of, n = ranks.get, self.bits, len(token)
        stop = list(range(1, n + 1))  # where the part that begins here ends
        before = list(range(-1, n - 1))  # where the part before the one that begins here begins
        pair = [rank_of(token[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        top, low, buckets = 0, {}, {}
        due = [(rank, i) for i, rank in enumerate(pair) if rank >= 0]
        while True:
            for rank, i in due:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [i]
                    group = rank >> 8
                    low[group] = low.get(group, 0) | bit_of[rank & 255]
                    top |= bit_of[group]
                else:
                    bucket.append(i)
            if not top:
                break
            group = (top & -top).bit_length() - 1
            bits = low[group]
            bit = bits & -bits
            low[group] = bits ^ bit
            if bits == bit:
                top ^= bit_of[group]
            lowest = group << 8 | bit.bit_length() - 1
            positions = buckets.pop(lowest)
            if len(positions) > 1:
                positions.sort()
            due, earlier = [], False
            for i in positions:
                if pair[i] != lowest:
                    continue  # stale: a part of the pair has been merged with another
                if earlier:
                    due.append((lowest, i))  # a rank below this one has come up: it goes first
                    continue
                j = stop[i]
                end = stop[i] = stop[j]
                pair[j] = rank = -1
                if end < n:
                    before[end] = i
                    rank = rank_of(token[i : stop[end]], -1)
                    if rank >= 0:
                        due.append((rank, i))
                        earlier = rank < lowest
                pair[i] = rank
                left = before[i]
                if left >= 0:
                    pair[left] = rank = rank_of(token[left:end], -1)
                    if rank >= 0:
                        due.append((rank, left))
                        earlier = earlier or rank < lowest
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : stop[i]]])
            i = stop[i]
        return out

    def _solve(self, tokens: list[str]) -> list[bytes]:
        """The ids of distinct pre-tokens as 32-bit integers."""
        get, put, encode, out = self.memo.get, self.memo.put, self.encode_bytes, []
        for t in tokens:
            value = get(t)
            if value is None:
                value = array("i", encode(t.encode("utf-8", "surrogatepass"))).tobytes()
                put(t, value)
            out.append(value)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text; each match of the pattern is encoded separately."""
        return array("i", self.parts.text(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_LOADED: dict[tuple[str, str], Bpe] = {}


def bpe(path: str, pattern: str) -> Bpe:
    """One encoder for each process and vocabulary, with its memo."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe.load(path, pattern)
    return _LOADED[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with an array column of the ids of a text column; null texts have none (an empty array)."""
    ship(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        coder = bpe(path, pattern)
        return pa.array([coder.encode(x or "") for x in column.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def decode_column(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with a binary column of the bytes that an array of ids stands for; a null array gives null."""
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    def decoded(column: pa.Array) -> pa.Array:
        coder = bpe(path, pattern)
        return pa.array([None if x is None else coder.decode(x) for x in column.to_pylist()], pa.binary())

    return docs.withColumn(out, decoded(F.col(ids)))


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Digests:
    """n_tokens, ids_sha256 and decoded_sha256 of texts; an id's decimal form and bytes are taken from tables."""

    def __init__(self, coder: Bpe):
        self.coder = coder
        n = max(coder.vocabulary, default=-1) + 1
        self.decimal = pa.array([f"{i}," for i in range(n)], pa.large_string())
        self.octets = pa.array([coder.vocabulary.get(i, b"") for i in range(n)], pa.large_binary())

    def __call__(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        found, ends = self.coder.parts.column(texts)
        ids, ends = pa.array(found.view(np.int32)), np.concatenate(([0], ends))
        return np.diff(ends).tolist(), self._sha256(self.decimal.take(ids), ends, 1), self._sha256(self.octets.take(ids), ends, 0)

    @staticmethod
    def _sha256(taken: pa.Array, ends: np.ndarray, less: int) -> list[str]:
        """Of the values between each two ends, one after another, without the last `less` bytes."""
        if not len(taken):
            return [hashlib.sha256().hexdigest()] * (len(ends) - 1)
        at = np.frombuffer(taken.buffers()[1], np.int64)[ends].tolist()
        data = memoryview(taken.buffers()[2])
        return [hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(at, at[1:], strict=False)]


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of `docs` (doc_id, text; others are ignored).

    Null and empty texts have no tokens and the digests of empty strings; repeated rows and rows without an id get their
    results each; an empty table gives an empty result; texts are encoded whole, however long.  A vocabulary may have any
    ranks; it has to hold the 256 bytes.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Digests(bpe(path, pattern))
        for batch in pieces(gathered(batches, "text", 4 << 20), "text", 6 << 20):
            yield batch_of(_DIGESTS, batch.column("doc_id"), *of(batch.column("text")))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern())
