"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct buckets of its words, pairs of neighbours, and pairs with one or two
words between (words as runs of digits, letters and non-ASCII characters, A-Z lower-cased).  Training
walks a bounded sample of labelled rows in one task, with a learning rate for each coordinate and an L1
term that leaves few weights other than zero; those alone reach the driver and are broadcast.  An eighth of
the sample is kept from training and sets the margin that stands for a score of one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix64, octets, pieces, read, ship, trim
from .words import ALNUM, word_hashes

#: Buckets of the feature hash (a power of two), and the most labelled rows that training looks at.
BITS, SAMPLE = 22, 12_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.0, 4


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and buckets of all features of a binary column, with repeats."""
    hashes, bounds = word_hashes(column, ALNUM)
    rows = np.repeat(np.arange(len(column)), np.diff(bounds))
    shift = U64(64 - bits)
    where, found = [rows], [hashes >> shift]
    for gap in (1, 2, 3):
        if len(hashes) > gap:
            pair = mix64(hashes[:-gap] * U64(0x9FB21C651E98DF25) + hashes[gap:] + U64(gap)) >> shift
            same = rows[:-gap] == rows[gap:]
            where.append(rows[:-gap][same])
            found.append(pair[same])
    return np.concatenate(where), np.concatenate(found).astype(np.int64)


class Ftrl:
    """FTRL-proximal for binary features; a weight is derived from its sums z and n when it is needed."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def cutoff(margins: np.ndarray, labels: np.ndarray, least: int = 10) -> float:
    """The margin that separates labels best (by F1) on rows that training has not seen, in the middle of the
    gap that it may lie in; 0 where there are fewer than `least` rows of either label."""
    if min((labels == 1).sum(), (labels == 0).sum()) < least:
        return 0.0
    order = np.argsort(-margins, kind="stable")
    found = np.cumsum(labels[order])
    f1 = 2 * found / (np.arange(1, len(order) + 1) + labels.sum())
    ends = np.append(margins[order][1:] < margins[order][:-1], True)
    best = int(np.argmax(np.where(ends, f1, -1)))
    low = margins[order][best + 1] if best + 1 < len(order) else margins[order][best] - 1
    return float((margins[order][best] + low) / 2)


def _fitting(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, labels = [], []
        bias = np.array([1 << bits])
        for batch in pieces(batches, "text", 2 << 20):
            rows, found = features(batch.column("text"), bits)
            key = np.unique((rows.astype(np.int64) << bits) | found)
            ends = np.searchsorted(key >> bits, np.arange(batch.num_rows + 1))
            buckets = (key & ((1 << bits) - 1)).astype(np.int32)
            seen += [np.append(buckets[a:b], bias).astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            labels += batch.column("toxic").to_pylist()
        model = Ftrl((1 << bits) + 1)
        order = np.random.default_rng(7).permutation(len(seen))
        kept, learned = order[: len(order) // 8], order[len(order) // 8 :]
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(learned).tolist():
                model.learn(seen[i], labels[i])
        w = np.concatenate([model.weights(slice(a, a + (1 << 18))) for a in range(0, len(model.z), 1 << 18)])
        del model
        w[-1] -= cutoff(np.array([w[seen[i]].sum() for i in kept]), np.array([labels[i] for i in kept]))
        at = np.flatnonzero(w)
        del seen
        trim()
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "weight": pa.array(w[at], pa.float64())})

    return run


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Dense weights with the bias at the end, learned from `labels` (doc_id, toxic) of texts in `docs`.

    At most `sample` labelled documents are used, in the order of a hash of doc_id.  Labels other than 0
    and 1 are ignored; a document with several labels is toxic if one says so.  Without labels all weights
    are zero but the bias, which says clean.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample)
    texts = docs.select("doc_id", octets("text").alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    ordered = texts.repartition(1).sortWithinPartitions("doc_id", "text").select("text", F.col("toxic").cast("int"))
    found = ordered.mapInArrow(_fitting(bits, epochs), "bucket bigint, weight double").toPandas()  # 2^bits + 1 rows at most
    weights = np.zeros((1 << bits) + 1)
    weights[found["bucket"].to_numpy(dtype=np.int64)] = found["weight"].to_numpy(dtype=float)
    if not len(found):
        weights[-1] = -1.0
    return weights


def scorer(spark: SparkSession, weights: np.ndarray):
    """A column function of binary texts: scores between 0 and 1."""
    ship(spark)
    at = np.flatnonzero(weights)
    sent = spark.sparkContext.broadcast((len(weights), at.astype(np.int32), weights[at]))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        size, at, values = sent.value
        dense = np.zeros(size, np.float32)
        dense[at] = values
        bits = (size - 1).bit_length() - 1
        out = []
        column = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        for batch in pieces([pa.RecordBatch.from_arrays([column], ["text"])], "text", 2 << 20):
            rows, found = features(batch.column("text"), bits)
            hit = dense[found] != 0
            key = np.unique((rows[hit].astype(np.int64) << bits) | found[hit])
            sums = np.bincount(key >> bits, weights=dense[key & ((1 << bits) - 1)], minlength=batch.num_rows)
            out.append(1 / (1 + np.exp(-np.clip(sums + dense[-1], -35, 35))))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return score


def _split() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`.

    Rows whose crc32(doc_id) mod 5 is 0 are held out of training (a null doc_id counts as an empty text).
    Null and empty texts get the bias's score, very long ones are scored whole.  Repeated rows are scored alike; a score
    of exactly one half is toxic; an empty table gives an empty result; columns beside doc_id and text, whatever their
    names, are not looked at.
    """
    weights = train(docs, labels.where(_split() != 0), **options)
    score = scorer(docs.sparkSession, weights)
    out = docs.select("doc_id", (_split() == 0).alias("held_out"), score(octets("text")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, that are scored under 0.5 (see `toxicity`): each row by its own text, whatever its
    doc_id, so rows without an id and repeated rows stay or go by their texts.  Without labels all rows stay."""
    score = scorer(docs.sparkSession, train(docs, labels.where(_split() != 0), **options))
    return docs.where(score(octets("text")) < 0.5)


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
