"""Chat logs: snapshots of a conversation that a longer log continues are dropped, the rest is rendered.

A conversation's turns are numbered in the order of (turn, role, text).  The rolling hash of its first n
turns is the sum of the turns' hashes, each taken with its number, in four lanes of 32 bits of MD5; sums
are prefix sums over blocks of turns, so that one conversation may be spread over many tasks.  A
conversation is dropped when its hash and length are those of a proper prefix of another (an anti-join with
the distinct prefixes); of conversations with equal turns the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, ship

#: Turns that are numbered and rendered together; a longer conversation has several parts.
PART = 1024
_LANES = ("h0", "h1", "h2", "h3")


def numbered(chats: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, role, text and n (0, 1, ... in the order of turn, role, text); null roles and texts are empty.

    Turn numbers are cut into ranges of `part`; ranks within a range and the ranges' sizes give the number.
    """
    rows = chats.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                        F.floor(F.coalesce("turn", F.lit(0)) / part).alias("range")).distinct()
    rows = rows.withColumn("range", F.when(F.col("turn").isNull(), F.lit(None).cast("bigint")).otherwise(F.col("range")))
    sizes = rows.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy(F.col("range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("rank", F.row_number().over(within) - 1)
    both = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("range").eqNullSafe(F.col("r")))
    return both.select("conv_id", "role", "text", (F.col("base") + F.col("rank")).alias("n"))


def prefixes(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, n and the hash lanes of the first n + 1 turns, from what `numbered` gives."""
    digest = F.md5(F.concat_ws("\x00", F.col("n").cast("string"), F.length("role").cast("string"), "role", "text"))
    lanes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(h) for i, h in enumerate(_LANES)]
    rows = turns.select("conv_id", "n", F.floor(F.col("n") / part).alias("block"), *lanes)
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(h).alias(h) for h in _LANES])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"{h}b") for h in _LANES])
    within = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "n", "block", *[F.sum(h).over(within).alias(h) for h in _LANES])
    both = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return both.select("conv_id", "n", *[(F.col(h) + F.col(f"{h}b")).alias(h) for h in _LANES])


def maximal(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id and n_turns of the conversations that no other continues, one of each set of equal ones."""
    rolling = materialize(prefixes(turns, part), "prefixes")
    ends = rolling.groupBy("conv_id").agg(F.max("n").alias("last"))
    ends = ends.withColumnRenamed("conv_id", "c")
    marked = rolling.join(ends, F.col("conv_id").eqNullSafe(F.col("c")))
    proper = marked.where("n < last").select("n", *_LANES).distinct()
    whole = marked.where("n = last").groupBy("n", *_LANES).agg(F.min("conv_id").alias("conv_id"))
    return whole.join(proper, ["n", *_LANES], "left_anti").select("conv_id", (F.col("n") + 1).alias("n_turns"))


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template; marks of the template in a text are taken apart by a blank."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), plain(role), F.lit("\n"), plain(text), F.lit("<|im_end|>\n"))


def chats(conversations: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, n_turns, part and rendered text of the maximal conversations (conv_id, turn, role, text; other
    columns are ignored).

    Rows without conv_id form one conversation.  Turns without number come first; null roles and texts
    count as empty; rows repeated in a conversation count once, and turns of equal number stand in the order
    of role and text.  A conversation of more than `part` turns has a row for each `part` turns.
    """
    ship(conversations.sparkSession)
    turns = materialize(numbered(conversations, part), "turns")
    kept = maximal(turns, part).withColumnRenamed("conv_id", "c")
    rows = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
    lines = F.array_sort(F.collect_list(F.struct("n", render(F.col("role"), F.col("text")).alias("line"))))
    out = rows.groupBy("conv_id", "n_turns", F.floor(F.col("n") / part).alias("part")).agg(lines.alias("lines"))
    return out.select("conv_id", "n_turns", "part", F.array_join("lines.line", "").alias("rendered"))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(read(spark, sf_dir, "conversations"))


OP1_SQL = """
with turns as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as n from turns),
rolling as (
  select conv_id, n, max(n) over (partition by conv_id) as last,
    sha256(string_agg(n || '|' || length(role) || '|' || role || '|' || text, chr(0)) over (partition by conv_id order by n)) as h
  from numbered),
whole as (
  select n, h, min(conv_id) as conv_id from rolling where n = last group by n, h),
kept as (
  select conv_id, n + 1 as n_turns from whole where not exists (
    select 1 from rolling r where r.n < r.last and r.n = whole.n and r.h = whole.h))
select k.conv_id, k.n_turns, t.n // 1024 as part,
  string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), ''
             order by t.n) as rendered
from kept k join numbered t on t.conv_id is not distinct from k.conv_id
group by k.conv_id, k.n_turns, t.n // 1024
"""
