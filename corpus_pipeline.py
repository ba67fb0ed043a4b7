"""A corpus pipeline of four stages: toxicity, near-duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs.  All but the last return the columns of `documents`.

Every stage takes rows with a null in any column, empty and very long texts, repeated rows, rows that share an id, empty
tables and further columns: rows are judged each by its own text, and what that means is stated by the functions that
the stages call (`toxicity.keep_clean`, `minhash.keep_one`, `decontaminate.decontaminate`, `bpe.digests`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellframe.llm import bpe, decontaminate, minhash, toxicity
from cellframe.llm.common import materialize, read


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates."""
    return minhash.keep_one(docs, k=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of benchmark items."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of ids and the digests of ids and decoded bytes of each document that is left."""
    return bpe.digests(docs, bpe.tokenizer_path("byte_bpe_multi_50k.tiktoken"), bpe.pattern())


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("bpe", encode)]

#: Toxicity is a trained model, which SQL cannot express: tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
