"""Near-duplicate classes: circulant MinHash banding, exact Jaccard verification, connected components.

Circulant MinHash draws every coordinate from two permutations: `sigma` scatters a shingle over
[0, 2^32), and coordinate k is the minimum over the set of `pi` applied to the scattered value
shifted circularly by k.  Coordinates are cut into bands; documents that share a band are candidates.

How skew is met:
* documents with equal shingle sets form a class, and only one document per class is banded;
* in each bucket the members link to two pivots (smallest and largest id), never to each other;
* candidate links stand behind bounds that lose none (set sizes; a one-bit sketch of the signature whose
  bound lies more than five standard deviations under the threshold) and are confirmed on full sets;
* buckets that still hold several components are looked at again: the members outside the bucket's
  largest component are compared on full sets with all documents of such buckets of that component, in
  blocks of bounded size, through an inverted index in each block; blocks give out links only, at most
  one for each stray document and other component, so no pairs are ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, batch_of, files_for, materialize, mix64, octets, pieces, read, remove, ship
from .words import BLANK, sets

BANDS, ROWS = 25, 5
#: Shingles of stray documents in a block; a block has four times as many of other documents.
BLOCK = 250_000
_SIG = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("s1", pa.int64()),
                  ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SIG_DDL = "doc_id bigint, text_key bigint, n bigint, digest binary, s1 bigint, s2 bigint, bands array<bigint>"


def signatures(items: list[np.ndarray], size: int) -> np.ndarray:
    """`size` circulant MinHash coordinates of each set of 64-bit hashes; zeros for an empty set."""
    out = np.zeros((len(items), size), np.uint32)
    rows = [i for i, x in enumerate(items) if len(x)]
    at = 0
    while at < len(rows):
        end, total = at, 0
        while end < len(rows) and (end == at or total + len(items[rows[end]]) <= 65_536):
            total += len(items[rows[end]])
            end += 1
        part = [items[i] for i in rows[at:end]]
        first = np.concatenate(([0], np.cumsum([len(x) for x in part])[:-1]))
        sigma = (mix64(np.concatenate(part) * U64(0xD6E8FEB86659FD93)) >> U64(32)).astype(np.uint32)
        x, y, low = np.empty_like(sigma), np.empty_like(sigma), np.empty((size, len(part)), np.uint32)
        for k in range(size):
            np.subtract(sigma, np.uint32(k + 1), out=x)  # the circular shift; what follows is pi, a bijection
            x ^= np.right_shift(x, np.uint32(16), out=y)
            x *= np.uint32(0x85EBCA6B)
            x ^= np.right_shift(x, np.uint32(13), out=y)
            x *= np.uint32(0xC2B2AE35)
            x ^= np.right_shift(x, np.uint32(16), out=y)
            np.minimum.reduceat(x, first, out=low[k])
        out[rows[at:end]] = low.T
        at = end
    return out


def _signing(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, bands + 1, dtype=U64))
        for batch in pieces(batches, "text", 4 << 20):
            items = sets(batch.column("text"), BLANK, k)
            n = [len(x) for x in items]
            digest = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in items]
            sig = signatures(items, bands * rows)
            keys = np.repeat(salt[None, :], len(sig), axis=0)
            for r in range(rows):
                keys += sig[:, r::rows].astype(U64)
                mix64(keys)
            bits = np.packbits(((sig[:, :128] >> np.uint32(7)) & np.uint32(1)).astype(np.uint8), axis=1)
            bits = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, 16 - bits.shape[1])))).view(np.int64)
            offsets = np.arange(0, len(sig) * bands + 1, bands, dtype=np.int32)
            yield batch_of(_SIG, batch.column("doc_id"), batch.column("text_key"), n, digest, pa.array(bits[:, 0]), pa.array(bits[:, 1]),
                           pa.ListArray.from_arrays(offsets, keys.view(np.int64).ravel()))

    return run


def _jaccard(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(pieces([whole], "ta", 4 << 20), "tb", 4 << 20):
                keep = []
                for x, y in zip(sets(batch.column("ta"), BLANK, k), sets(batch.column("tb"), BLANK, k), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block(k: int, percent: int):
    """Links between the stray documents of a block and all its documents of other components: one for each
    stray document and other component."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        strays, n = table.filter(table["stray"]), table.num_rows
        a, b = [], []
        if strays.num_rows and n:
            of = np.unique(strays["rep"].to_numpy(), return_index=True)[1]
            strays = strays.take(pa.array(of))
            items = sets(strays["text"].combine_chunks(), BLANK, k)
            sizes = np.array([len(x) for x in items])
            comp, rep = strays["comp"].to_numpy(), strays["rep"].to_numpy()
            owner = np.repeat(np.arange(len(items)), sizes)
            values = np.concatenate(items)
            order = np.argsort(values, kind="stable")
            owner, (values, first, count) = owner[order], np.unique(values[order], return_index=True, return_counts=True)
            met: set = set()
            members = table.filter(table["member"])
            for batch in pieces(members.to_batches(), "text", 4 << 20):
                rows = zip(batch["rep"].to_pylist(), batch["comp"].to_pylist(), sets(batch["text"], BLANK, k), strict=True)
                for r, c, x in rows:
                    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
                    at = at[values[at] == x]
                    size = count[at]
                    total = int(size.sum())
                    if not total:
                        continue
                    skip = np.repeat(first[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
                    common = np.bincount(owner[skip + np.arange(total)], minlength=len(items))
                    linked = (100 * common >= percent * (sizes + len(x) - common)) & (comp != c) & (rep != r)
                    for i in np.flatnonzero(linked).tolist():
                        if (i, c) not in met:
                            met.add((i, c))
                            a.append(int(comp[i]))
                            b.append(c)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _near(percent: int, bits: int) -> Column:
    """Bounds that every linked pair meets: the sizes' (exact) and the sketch's (five deviations and more)."""
    share = percent / 100
    agree = (1 + share) / 2
    least = agree - 5.5 * (agree * (1 - agree) / bits) ** 0.5
    differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("o1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("o2")))
    return ((100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")) & (differ <= int((1 - least) * bits)))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those whose full sets are near; texts: rep, text of class representatives."""
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(
        _jaccard(k, percent), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """id and comp for each id on an edge (a, b): comp is the smallest id that it reaches (and a column `was`), as a table.

    Each round takes the smallest label among the neighbours and then the label's own label.  Every round's
    labels are a table of their own, so no lineage grows, and only numbers come to the driver."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(),
                       "edges", files_for(2 * edges.count()))
    files = files_for(both.count())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(
        "id", F.col("id").alias("was"), F.least("id", "m").alias("comp")), "labels", files)
    while True:
        now = labels.select("id", "comp")
        near = both.join(now, both.b == now.id).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        step = now.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        up = step.select(F.col("id").alias("comp"), F.col("comp").alias("higher"))
        after = materialize(step.join(up, "comp").select("id", "was", F.col("higher").alias("comp")), "labels", files)
        remove(labels)
        labels = after
        if after.where("was <> comp").isEmpty():
            remove(both)
            return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs` (doc_id, text; other columns are ignored).

    Documents are linked when 100 * |A & B| >= percent * |A | B| over distinct k-word shingles.
    Null, empty and blank texts have no shingles, link with nothing and are kept.  Rows that repeat a
    doc_id get the same verdict when their texts are equal; a null doc_id is kept only if its whole
    class has no id.  An empty table gives an empty result.  Very long texts are hashed whole, segment by segment.
    Intermediate tables are removed but for the last ones, which the result reads.
    """
    return _judged(docs, k, percent, **options).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, k: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """What `near_duplicates` gives, with text_key, a hash of the row's text."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), octets("text").alias("text"))
    sig = materialize(base.withColumn("text_key", F.xxhash64("text")).mapInArrow(_signing(k, bands, rows), _SIG_DDL), "signatures")
    files = files_for(sig.count())  # of tables with a few rows for each document
    full = sig.where("n > 0")
    reps = materialize(
        full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("s1").alias("s1"),
                                   F.first("s2").alias("s2"), F.first("bands").alias("bands")),
        "classes", files)
    able = reps.where("rep is not null")
    members = able.select("rep", F.explode("bands").alias("key"))
    pivots = members.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    shared = materialize(members.join(pivots, "key"), "buckets", files)
    facts = able.select("rep", "n", "s1", "s2")
    star = shared.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("rep").alias("b")),
                                           F.struct(F.col("rep").alias("a"), F.col("hi").alias("b")))).alias("p"))
    star = star.select("p.a", "p.b").where("a < b").distinct()
    o = facts.select(F.col("rep").alias("b"), F.col("n").alias("o_n"), F.col("s1").alias("o1"), F.col("s2").alias("o2"))
    near = _near(percent, min(128, bands * rows))
    star = materialize(star.join(facts.withColumnRenamed("rep", "a"), "a").join(o, "b").where(near).select("a", "b"), "star", files)
    asked = star.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    # The whole texts are dealt once, by a merge join at every size; what follows draws on this pool.
    texts = base.withColumnRenamed("doc_id", "rep").join(shared.select("rep").distinct().hint("merge"), "rep", "left_semi")
    texts = materialize(texts, "pool", files)
    edges = materialize(_verified(star, _texts(texts, asked), k, percent), "links")
    labels = components(edges)

    # Buckets that hold more than one component: members outside the largest one meet all others.
    known = shared.select("key", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("comp", "rep").alias("comp"))
    counted = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    mixed = counted.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    mixed = mixed.where("kinds > 1").select("key", F.col("top.comp").alias("main"))
    strays = known.join(mixed, "key").select("main", "rep", "comp").distinct()
    strays = strays.join(facts.select("rep", "n"), "rep").select(
        "main", "rep", "comp", "n", (F.col("comp") != F.col("main")).alias("stray"))
    strays = materialize(strays, "strays", files)
    remove(star)
    if not strays.isEmpty():
        more = materialize(_strays_met(strays, texts, k, percent), "links")
        if not more.isEmpty():
            before, labels = labels, components(edges.union(labels.select(F.col("comp"), F.col("id"))).union(more))
            remove(before)
        remove(more)
    remove(shared, texts, edges, strays)

    found = reps.select("digest", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", F.coalesce("comp", "rep").alias("component_id"))
    out = full.select("doc_id", "text_key", "n", "digest").join(found, "digest").select("doc_id", "text_key", "n", "component_id")
    out = out.union(sig.where("n = 0").select("doc_id", "text_key", "n", "doc_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _strays_met(strays: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components: each stray of a `main` meets all its documents of other components."""
    sizes = strays.groupBy("main").agg(
        F.ceil(F.sum(F.when(F.col("stray"), F.col("n")).otherwise(0)) / BLOCK).cast("int").alias("ns"),
        F.ceil(F.sum("n") / (4 * BLOCK)).cast("int").alias("nm"))
    dealt = strays.join(sizes, "main")
    row = F.pmod(F.xxhash64("rep"), "ns").cast("int")
    col = F.pmod(F.xxhash64("comp", "rep"), "nm").cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = dealt.where("stray").select("main", "rep", "comp", F.lit(True).alias("stray"), F.lit(False).alias("member"),
                                        row.alias("i"), F.explode(span("nm")).alias("j")).union(
        dealt.select("main", "rep", "comp", F.lit(False), F.lit(True), F.explode(span("ns")), col))
    blocks = dealt.join(_texts(texts, strays.select("rep").distinct()), "rep")
    return blocks.groupBy("main", "i", "j").applyInArrow(_block(k, percent), "a bigint, b bigint")


def _texts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """One text for each id asked for (rows that repeat an id and text count once)."""
    return texts.join(asked, "rep", "left_semi")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """`docs` without the documents that are not their component's smallest id.

    Rows without an id take part, each as a document of its own behind all ids: such a row is kept only if its
    component has no id and it is the component's first, by the digest of its text.  Rows that repeat an id and a text
    stay or go together; rows of one id with different texts are judged each by its own.  Null and blank texts stay.
    """
    count, top, total = docs.agg(F.count(F.when(F.col("doc_id").isNull(), 1)), F.max(F.col("doc_id").cast("bigint")), F.count(F.lit(1))).first()
    keyed = docs.withColumn("__key", F.col("doc_id").cast("bigint"))
    if count:
        at = F.monotonically_increasing_id() + F.lit(-1 if top is None else top) + 1
        unnamed = docs.where("doc_id is null").orderBy(F.sha2(octets("text"), 256)).withColumn("__key", at)
        keyed = keyed.where("doc_id is not null").union(materialize(unnamed, "unnamed"))
    found = _judged(keyed.select(F.col("__key").alias("doc_id"), "text"), k, percent, **options)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__text")).distinct()
    same = (F.col("__key") == F.col("__gone")) & (F.xxhash64(octets(F.col("text"))) == F.col("__text"))
    return keyed.join(gone, same, "left_anti").drop("__key").coalesce(files_for(total))


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


OP5_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g
  from words where len(w) > 0),
sizes as (
  select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from shingles x join shingles y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reached as (
  select doc_id, doc_id as other from words union
  select r.doc_id, e.b from reached r join (select a, b from links union all select b, a from links) e on r.other = e.a),
comps as (
  select doc_id, min(other) as component_id from reached group by doc_id)
select w.doc_id, coalesce(n, 0) as n_shingles, component_id, w.doc_id = component_id as kept
from words w join comps using (doc_id) left join sizes using (doc_id)
"""
