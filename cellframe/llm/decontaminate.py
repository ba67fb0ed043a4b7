"""Benchmark decontamination: hashed windows of test items are broadcast and sought in all token windows.

A window is 13 consecutive words of an item (the whole item if it has fewer).  A document window whose
hash is in the broadcast set is compared word by word with the item; what matches marks its words.
The benchmark's size is measured first.  Beyond `limit` bytes it is dealt into blocks that each stay
under it, and the documents are scanned once for each block; only the blocks' hits are then merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, materialize, mix64, octets, pieces, read, ship
from .words import ALNUM, word_hashes

WIDTH = 13
LIMIT = 16 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _words(text: bytes) -> list[bytes]:
    return [w.lower() for w in _WORD.findall(text)]


def _grown(hashes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The hashes of all runs of each of the lengths (ascending), grown word by word."""
    out = np.full(len(hashes), 0x243F6A8885A308D3, U64)
    for i in range(lengths[-1] if lengths else 0):
        out = out[: max(0, len(hashes) - i)]
        out += hashes[i:]
        mix64(out)
        if i + 1 in lengths:
            yield i + 1, out


class Index:
    """Windows of items: sorted hashes, and for each the items and places that have it."""

    def __init__(self, items: list[tuple], width: int):
        self.names = [name for name, _ in items]
        self.words = [_words(text) for _, text in items]
        column = pa.array([text for _, text in items], pa.binary())
        hashes, bounds = word_hashes(column, ALNUM)
        found: dict[int, list[tuple[int, int]]] = {}
        self.lengths = sorted({min(width, len(w)) for w in self.words if w})
        for length, grams in _grown(hashes, self.lengths):
            for item, words in enumerate(self.words):
                if min(width, len(words)) == length:
                    a = int(bounds[item])
                    for at, gram in enumerate(grams[a : a + len(words) - length + 1].tolist()):
                        found.setdefault(gram, []).append((item, at))
        self.hashes = np.array(sorted(found), U64)
        self.places = [found[int(h)] for h in self.hashes]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.hashes >> U64(42)).astype(np.int64)] = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "sieve"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.hashes >> U64(42)).astype(np.int64)] = True

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """(number of words, spans of words hit, items found) for each row."""
        hashes, bounds = word_hashes(column, ALNUM)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for length, grams in _grown(hashes, self.lengths):
            at = np.flatnonzero(self.sieve[(grams >> U64(42)).astype(np.int64)])
            if not len(at):
                continue
            slot = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
            same = self.hashes[slot] == grams[at]
            at, slot = at[same], slot[same]
            row = np.searchsorted(bounds, at, side="right") - 1
            inside = at + length <= bounds[row + 1]
            for r, a, s in zip(row[inside].tolist(), at[inside].tolist(), slot[inside].tolist(), strict=True):
                hits.setdefault(r, []).append((a - int(bounds[r]), length, s))
        sizes = np.diff(bounds).tolist()
        for r, size in enumerate(sizes):
            spans, items = [], set()
            if r in hits:
                words = _words(column[r].as_py())
                for a, length, s in sorted(hits[r]):
                    mine = words[a : a + length]
                    real = [i for i, p in self.places[s] if self.words[i][p : p + length] == mine]
                    if real:
                        items.update(real)
                        if spans and a <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], a + length))
                        else:
                            spans.append((a, a + length))
            yield size, spans, items


_OUT = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
_DDL = "n_words bigint, spans array<array<bigint>>, items array<string>"


def _scanning(sent, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in pieces(batches, "text", 2 << 20):
            n, spans, items = [], [], []
            for size, marks, found in index.scan(batch.column("text")):
                n.append(size)
                spans.append([list(m) for m in marks])
                items.append(sorted({str(index.names[i]) for i in found if index.names[i] is not None}))
            kept = batch if with_text else batch.drop_columns(["text"])
            made = [pa.array(x, f.type) for x, f in zip((n, spans, items), _OUT, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, *_OUT.names])

    return run


def _blocks(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    rows = benchmark.select("item_id", octets("text").alias("text"))
    size = rows.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = -(-size // limit) or 1
    if n == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n)) == i) for i in range(2 * n)]


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_words, spans (word ranges hit, merged, in order) and items (ids found, as sorted strings).

    `docs` has doc_id and text, `benchmark` item_id and text; other columns are ignored.  Null and empty
    texts have no words and no hits.  Items without words have no window; items without an id mark words
    but are not named.  Repeated rows and items get equal results, very long texts are scanned whole.  An empty benchmark
    hits nothing, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select("doc_id", octets("text").alias("text"))
    blocks = _blocks(benchmark, limit)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if len(blocks) == 1:
        sent = spark.sparkContext.broadcast(_index(blocks[0], width))
        return base.mapInArrow(_scanning(sent, False), f"doc_id {kind}, {_DDL}")
    keyed = base.select("doc_id", F.sha2("text", 256).alias("key"), "text")
    found = None
    for block in blocks:
        sent = spark.sparkContext.broadcast(_index(block, width))
        part = materialize(keyed.mapInArrow(_scanning(sent, False), f"doc_id {kind}, key string, {_DDL}").where(
            "size(spans) > 0").distinct(), "hits")
        sent.unpersist()
        found = part if found is None else found.union(part)
    merged = found.groupBy(F.col("doc_id").alias("__id"), "key").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.select("__id", F.col("key").alias("__key"), "items", F.expr("""
        aggregate(all, cast(array() as array<array<bigint>>), (got, s) -> if(
            size(got) > 0 and s[0] <= element_at(got, -1)[1],
            concat(slice(got, 1, size(got) - 1), array(array(element_at(got, -1)[0], greatest(element_at(got, -1)[1], s[1])))),
            concat(got, array(s))))""").alias("spans"))
    counted = keyed.mapInArrow(_scanning(spark.sparkContext.broadcast(Index([], width)), False), f"doc_id {kind}, key string, {_DDL}")
    both = counted.select("doc_id", "key", "n_words").join(
        merged, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return both.select("doc_id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<array<bigint>>)")).alias("spans"),
                       F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def _index(block: DataFrame, width: int) -> Index:
    """One block of the benchmark, whose size was measured, on the driver."""
    return Index([(r[0], bytes(r[1])) for r in block.collect()], width)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more is hit)."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])")
    return occurrences(docs, benchmark, **options).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def _cut(text: bytes, spans: list) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", width: int = WIDTH,
                  limit: int = LIMIT) -> DataFrame:
    """`docs`, all columns, without contaminated documents ("documents") or with the hit words cut out ("spans").

    Each row is judged and cut by its own text, whatever its doc_id (null or repeated).  Null, empty and blank texts have no
    words and stay as they are; very long texts are scanned whole; an empty benchmark removes nothing; an empty table gives
    an empty result.  Several blocks of the benchmark give the same result as one: hits of all blocks are gathered on the
    original texts first.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    spark = docs.sparkSession
    ship(spark)
    blocks = _blocks(benchmark, limit)
    if len(blocks) > 1:
        key = F.sha2(octets("text"), 256)
        texts = docs.select(key.alias("doc_id"), "text")
        if mode == "documents":
            bad = contamination(texts, benchmark, width=width, limit=limit).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
            return docs.join(bad, key == F.col("__bad"), "left_anti")
        hits = occurrences(texts, benchmark, width=width, limit=limit).where("size(spans) > 0").groupBy(F.col("doc_id").alias("__key")).agg(
            F.first("spans").alias("__spans"))
        return docs.join(hits, key == F.col("__key"), "left").withColumn(
            "text", _cut_out()(F.col("text").cast("binary"), F.col("__spans")).cast("string")).select(*docs.columns)
    if mode == "spans":
        return docs.withColumn("text", _cutting(spark.sparkContext.broadcast(_index(blocks[0], width)))(F.col("text").cast("binary")).cast("string"))
    sent = spark.sparkContext.broadcast(_index(blocks[0], width))

    @F.arrow_udf("boolean")
    def dirty(text: pa.Array) -> pa.Array:
        out = []
        for batch in pieces([pa.RecordBatch.from_arrays([text], ["text"])], "text", 2 << 20):
            for size, spans, _ in sent.value.scan(batch.column("text")):
                hit = sum(b - a for a, b in spans)
                out.append(hit > 0 and 20 * hit >= size)
        return pa.array(out, pa.bool_())

    return docs.where(~dirty(octets("text")))


def _cut_out():
    @F.arrow_udf("binary")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([_cut(t, s) if t is not None and s else t for t, s in rows], pa.binary())

    return cut


def _cutting(sent):
    @F.arrow_udf("binary")
    def cut(text: pa.Array) -> pa.Array:
        out = []
        for batch in pieces([pa.RecordBatch.from_arrays([text.fill_null(b"")], ["text"])], "text", 2 << 20):
            column = batch.column("text")
            for i, (_, spans, _) in enumerate(sent.value.scan(column)):
                out.append(_cut(column[i].as_py(), spans) if spans else column[i].as_py())
        return pa.array([None if gone else x for x, gone in zip(out, text.is_null().to_pylist(), strict=True)], pa.binary())

    return cut


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, k, w[i : i + k - 1] as g from (select *, unnest(range(1, len(w) - k + 2)) as i from (select *, least(13, len(w)) as k from b where len(w) > 0))),
places as (
  select doc_id, k, i, w[i : i + k - 1] as g from (select *, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from windows) where len(w) >= k)),
hits as (
  select doc_id, i, k, item_id from places join windows using (k, g)),
marked as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hits where item_id is not null) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join marked using (doc_id) left join named using (doc_id)
"""
