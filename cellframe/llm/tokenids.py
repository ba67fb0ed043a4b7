"""Token-id files: canonical length-limited Huffman codes from global counts, decoded by table in blocks.

A file set in the shared folder has three tables:
* `codebook`: id and code length; canonical codes follow from the lengths alone;
* `tokens`: one row for each document, in ascending doc_id order within and across shards: shard, doc_id,
  n_tokens, the Huffman bits (most significant first), and a checkpoint, the bit offset of each block of
  256 ids.  Blocks are decoded independently of each other, many at once, one table look-up an id.

Steps: tokenise once into a table; count ids on the executors (the driver sees one row for each id);
encode each document; deal documents to shards by doc_id; sort; write.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import pattern, tokenizer_path
from .chunks import Parts
from .common import GROUP, batch_of, gathered, materialize, new_path, pieces, read, remove, ship

#: Ids of a block, and the longest code of vocabularies that it is long enough for (see `longest_for`).
BLOCK, LONGEST = 256, 18
#: The most different ids; the code table on the driver and executors is bounded by it.
MOST_IDS = 1 << 24
#: Where rows without a doc_id stand.
NO_ID = -(1 << 63)

_ENCODERS: dict[str, Parts] = {}
_ADDED: dict[str, tuple] = {}


def _encoder(path: str) -> Parts:
    """An encoder by parts, one a process, for a byte-level BPE file; parts hold no added tokens (see `_added`).

    The library's model merges all distinct words of a batch at once: they are joined by line ends, at which it cuts,
    and a token that begins with the blank's letter begins the next word."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer, pre_tokenizers

        model = Tokenizer.from_file(path).model
        lines = Tokenizer(model)
        lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        blank = chr(letters[32])
        table = np.array([letters.get(b, b) for b in range(256)], "<u4")
        joined = np.where(np.arange(256) == 10, 10, table).astype("<u4")
        begins = np.array([(lines.id_to_token(i) or "").startswith(blank) for i in range(lines.get_vocab_size())], bool)
        mark = np.uint32(lines.token_to_id(blank))

        def spelled(text: str, table: np.ndarray) -> str:
            return table[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes().decode("utf-32-le")

        def words(stems: pa.Array, lead: str) -> pa.Array:
            """Of words without a blank in front, each has a blank behind it, which is taken out again."""
            size = len(stems)
            at = np.append(np.arange(0, size, 4096), size).astype(np.int32)
            between = "\n " if lead else "\n \n"
            found, ends, total = [], [np.zeros(1, np.int64)], 0
            for text in pc.binary_join(pa.ListArray.from_arrays(pa.array(at), stems), between).to_pylist() if size else []:
                ids = np.array(lines.encode_batch_fast([spelled(lead + text + ("" if lead else "\n "), joined)], add_special_tokens=False)[0].ids, np.uint32)
                if lead:
                    ends.append(np.append(np.flatnonzero(begins[ids])[1:], len(ids)) + total)
                else:
                    last = np.flatnonzero(ids == mark)
                    ids = np.delete(ids, last)
                    ends.append(last - np.arange(len(last)) + total)
                found.append(ids)
                total += len(ids)
            data, offsets = np.concatenate(found) if found else np.empty(0, np.uint32), np.concatenate(ends) * 4
            if len(offsets) != size + 1:
                raise ValueError(f"{path} is no byte-level vocabulary: {len(offsets) - 1} words are found in {size}")
            return pa.Array.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(offsets), pa.py_buffer(data)])

        def solve(tokens: list[str]) -> list[bytes]:
            return [array("I", [t.id for t in model.tokenize(spelled(x, table))]).tobytes() for x in tokens]

        _ENCODERS[path] = Parts(regex.compile(pattern()).findall, solve, words)
    return _ENCODERS[path]


def _added(path: str):
    """A search for the file's added tokens in a column, and the library's own encoder to ids for texts that hold one."""
    if path not in _ADDED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

        def special(column: pa.Array) -> np.ndarray:
            found = np.zeros(len(column), bool)
            for name in names:
                found |= pc.match_substring(column, name).to_numpy(zero_copy_only=False)
            return found

        _ADDED[path] = special, lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    return _ADDED[path]


_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def tokenise(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian 32-bit) of each text, with `end_id` appended.

    Added tokens of the file that stand in a text get their own ids, as by the library's defaults."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (special, whole) = _encoder(path), _added(path)
        for batch in pieces(gathered(batches, "text", 12 << 20), "text", 18 << 20):
            texts = batch.column("text")
            apart = special(texts)
            if apart.any():
                plain = pc.if_else(pa.array(apart), "", texts)
                ids, ends = encoder.column(plain)
                rows = np.split(ids, ends[:-1])
                for i in np.flatnonzero(apart).tolist():
                    rows[i] = whole(texts[i].as_py())
                ids, ends = np.concatenate(rows), np.cumsum([len(x) for x in rows])
            else:
                ids, ends = encoder.column(texts)
            size = np.diff(ends, prepend=0) + 1
            data, offsets, a = np.full(len(ids) + len(ends), end_id, "<u4"), np.concatenate(([0], np.cumsum(size) * 4)).astype(np.int32), 0
            for row, b in enumerate(ends.tolist()):
                data[a + row : b + row] = ids[a:b]
                a = b
            yield batch_of(_IDS, batch.column("doc_id"), pa.array(size),
                           pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids binary")


def _flat(column: pa.Array, kind=np.uint8) -> np.ndarray:
    if len(column) == 0 or column.buffers()[2] is None:
        return np.empty(0, kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        found = np.bincount(_flat(batch.column("ids"), np.uint32))
        if len(found) > len(total):
            found, total = total, found.astype(np.int64)
        total[: len(found)] += found
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "count": pa.array(total[at], pa.int64())})


def longest_for(n: int) -> int:
    """The longest code for n ids: two bits more than codes of equal length have, LONGEST at least."""
    return max(LONGEST, (max(1, n) - 1).bit_length() + 2)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits for positive counts (package-merge)."""
    n = len(counts)
    if n > 1 << longest:
        raise ValueError(f"{n} ids do not fit codes of {longest} bits")
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weight = counts[order].astype(np.int64)
    leaves = []  # for each level, whether the items in ascending order are leaves
    level = weight
    leaves.append(np.ones(n, bool))
    for _ in range(longest - 1):
        packed = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, packed))
        place = np.argsort(both, kind="stable")
        level = both[place]
        leaves.append(place < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(leaves):
        chosen = is_leaf[:take]
        own = int(chosen.sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: ids in the order of (length, id) get consecutive codes."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.longest = int(self.lengths.max(initial=1))
        span = np.left_shift(1, self.longest - self.lengths)
        self.codes = (np.cumsum(span) - span) >> (self.longest - self.lengths)
        self._tables()

    def _tables(self) -> None:
        size = int(self.ids.max(initial=0)) + 1
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        self.code_of[self.ids], self.length_of[self.ids] = self.codes.astype(np.uint64), self.lengths
        span = np.left_shift(1, self.longest - self.lengths)
        table = np.repeat(self.ids.astype(np.uint32) << np.uint32(5) | self.lengths.astype(np.uint32), span)
        self.table = np.zeros(1 << self.longest, np.uint32)
        self.table[: len(table)] = table

    def __getstate__(self):
        return self.ids, self.lengths

    def __setstate__(self, state):
        self.__init__(*state)

    def encode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents' ids, one after another up to `ends`: bytes of all documents (each begins at a byte), the
        byte at which each ends, and for each id its bit offset in its document."""
        length = self.length_of[ids].astype(np.int64)
        after = np.cumsum(length)
        begin = np.concatenate(([0], ends[:-1]))
        bits_end = np.where(ends > 0, after[np.maximum(ends - 1, 0)], 0)
        bits_begin = np.concatenate(([0], bits_end[:-1]))
        size = (bits_end - bits_begin + 7) >> 3
        byte_end = np.cumsum(size)
        inside = after - length - np.repeat(bits_begin, ends - begin)
        at = inside + np.repeat((byte_end - size) * 8, ends - begin)
        value = self.code_of[ids] << (64 - (at & 31) - length).astype(np.uint64)
        words = int(byte_end[-1] + 7) // 4 + 1 if len(byte_end) else 0
        slot = at >> 5
        high = np.bincount(slot, weights=(value >> np.uint64(32)).astype(float), minlength=words + 1)
        low = np.bincount(slot + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(float), minlength=words + 1)
        total = (high[: words + 1] + low[: words + 1]).astype(np.uint64).astype(">u4")
        return total.view(np.uint8), byte_end, inside

    def decode(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of blocks that begin at bits `starts` of `data` and have `counts` ids, one after another.

        All blocks advance together: each step looks up one id of every block that has any left."""
        padded = np.zeros((len(data) + 11) // 4 * 4, np.uint8)
        padded[: len(data)] = data
        words = padded.view(">u4").astype(np.uint64)
        out = np.empty(int(counts.sum()), np.uint32)
        place = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        at, place, left = starts[order].copy(), place[order].copy(), counts[order]
        alive = len(left) - np.searchsorted(left[::-1], np.arange(int(left.max(initial=0))), side="right")
        for m in alive.tolist():
            p = at[:m]
            w = p >> 5
            window = (words[w] << np.uint64(32)) | words[w + 1]
            window >>= (64 - self.longest - (p & 31)).astype(np.uint64)
            found = self.table[(window & np.uint64((1 << self.longest) - 1)).astype(np.int64)]
            out[place[:m]] = found >> np.uint32(5)
            place[:m] += 1
            at[:m] += found & np.uint32(31)
        return out


_ROWS = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("checkpoints", pa.binary()), ("payload", pa.binary()),
                   ("crc", pa.int64())])
_ROWS_DDL = "shard int, doc_id bigint, n_tokens bigint, checkpoints binary, payload binary"


def shards(bounds: np.ndarray, doc_id: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The shard of each row in the order of (doc_id, crc): shard i has the ids from bounds[i - 1] (without) to bounds[i].
    A doc_id that is several bounds has as many shards, dealt by the checksum of the row's ids."""
    low = np.searchsorted(bounds, doc_id, side="left")
    many = np.searchsorted(bounds, doc_id, side="right") - low
    return (low + (crc * np.maximum(many, 1) >> 32)).astype(np.int32)


def _encoding(sent, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.value
        for batch in pieces(batches, "ids", 1 << 20):
            ids = _flat(batch.column("ids"), np.uint32)
            n = batch.column("n_tokens").to_numpy()
            ends = np.cumsum(n)
            data, byte_end, inside = code.encode(ids, ends)
            raw, start = data.tobytes(), np.concatenate(([0], byte_end[:-1]))
            payload = [raw[a:b] for a, b in zip(start.tolist(), byte_end.tolist(), strict=True)]
            marks = [inside[a:b:BLOCK].astype("<u8").tobytes() for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            whole = memoryview(ids).cast("B")
            crc = np.array([zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)], np.int64)
            shard = shards(bounds, batch.column("doc_id").fill_null(NO_ID).to_numpy(), crc)
            yield batch_of(_ROWS, shard, batch.column("doc_id"), n, marks, payload, crc)

    return run


def write_tokens(ids: DataFrame, path: str, shard_tokens: int = 1 << 26) -> None:
    """Writes a file set of `ids` (doc_id, n_tokens, ids) under `path`; rows of a null doc_id come first.

    `ids` is read twice (counts, then codes), so it should be a table.  Rows of equal doc_id are ordered by
    the CRC-32 of their ids, and dealt to several shards where they are many.  An empty table gives an empty file set.
    """
    spark = ids.sparkSession
    ship(spark)
    counts = ids.mapInArrow(_counting, "id bigint, count bigint").groupBy("id").agg(F.sum("count").alias("count"))
    known = counts.limit(MOST_IDS + 1).toPandas()  # one row for each id
    if len(known) > MOST_IDS or len(known) and known["id"].max() >= 1 << 27:
        raise ValueError(f"more than {MOST_IDS} different ids")
    number = known["id"].to_numpy(dtype=np.int64)
    code = Code(number, code_lengths(known["count"].to_numpy(dtype=np.int64), longest_for(len(known))))
    spark.createDataFrame(pa.table({"id": code.ids, "length": code.lengths})).coalesce(1).write.parquet(f"{path}/codebook")
    total = int(known["count"].sum()) if len(known) else 0
    n = max(spark.sparkContext.defaultParallelism, -(-total // shard_tokens))
    keys = ids.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"))
    bounds = keys.approxQuantile("doc_id", [i / n for i in range(1, n)], max(1e-6, min(0.01, 0.1 / n))) if total and n > 1 else []
    bounds = np.array(sorted(bounds), float).astype(np.int64)
    rows = ids.mapInArrow(_encoding(spark.sparkContext.broadcast(code), bounds), f"{_ROWS_DDL}, crc bigint")
    rows = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("doc_id", "crc", "payload").drop("crc")
    rows.write.option("compression", "uncompressed").option("parquet.block.size", GROUP).parquet(f"{path}/tokens")


def _decoding(sent, digest: bool):
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.value
        for batch in pieces(batches, "payload", 4 << 20):
            n = batch.column("n_tokens").to_numpy()
            blocks = -(-n // BLOCK)
            marks = _flat(batch.column("checkpoints"), np.dtype("<u8")).astype(np.int64)
            offsets = np.frombuffer(batch.column("payload").buffers()[1], np.int32)
            offsets = offsets[batch.column("payload").offset :][: len(n)].astype(np.int64)
            starts = marks + np.repeat((offsets - offsets[:1]) * 8, blocks)
            first = np.cumsum(blocks) - blocks
            nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
            counts = np.minimum(BLOCK, np.repeat(n, blocks) - nth * BLOCK)
            raw = memoryview(code.decode(_flat(batch.column("payload")), starts, counts).astype("<u4").tobytes())
            ends = (np.cumsum(n) * 4).tolist()
            parts = [raw[b - 4 * k : b] for b, k in zip(ends, n.tolist(), strict=True)]
            yield batch_of(schema, batch.column("shard"), batch.column("doc_id"), batch.column("n_tokens"),
                           [zlib.crc32(p) if digest else p.tobytes() for p in parts])

    return run


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """shard, doc_id, n_tokens and ids (or their ids_crc32) of a file set, decoded block by block."""
    ship(spark)
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # MOST_IDS rows at most
    sent = spark.sparkContext.broadcast(Code(book["id"].to_numpy(), book["length"].to_numpy()))
    last = "ids_crc32 bigint" if digest else "ids binary"
    return spark.read.schema(_ROWS_DDL).parquet(f"{path}/tokens").mapInArrow(
        _decoding(sent, digest), f"shard int, doc_id bigint, n_tokens bigint, {last}")


def starts(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """`rows` with start: the ids of all rows before, from shards' totals (one row a shard) and sums within shards."""
    order = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    sums = totals.groupBy(F.col("shard").alias("s")).agg(F.sum("n_tokens").alias("sum")).select(
        "s", F.coalesce(F.sum("sum").over(order), F.lit(0)).alias("base"))
    before = Window.partitionBy("shard").orderBy("doc_id", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return inside.join(sums, F.col("shard") == F.col("s")).withColumn("start", F.col("base") + F.col("inside")).drop("s", "base", "inside")


def token_files(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row of `docs` as read back from a new file set.

    Null and empty texts have the end id only.  Columns beside doc_id and text are ignored; repeated rows
    are written each, and rows of equal doc_id stand in the order of their CRC-32; an empty table gives an empty
    result; texts are tokenised whole, however long, and take one row of a file each.
    """
    spark = docs.sparkSession
    where = new_path(spark, "token-files")
    ids = materialize(tokenise(docs, path, end_id), "ids")
    write_tokens(ids, where)
    remove(ids)
    stored = spark.read.schema(_ROWS_DDL).parquet(f"{where}/tokens").select("shard", "n_tokens")
    out = starts(read_tokens(spark, where, digest=True), stored)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
