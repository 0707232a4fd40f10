"""Order-sensitive operators that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import checkpointed

_RN = "__rn"


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None = 1, rank: str | None = None) -> DataFrame:
    """First k rows of each key in a total order (k None: all rows, ranked).

    `row_number() <= k` lets Spark plan a WindowGroupLimit below the shuffle, so each map task
    ships at most k rows per key and a hot key costs k rows per task, not its size.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(_RN, F.row_number().over(w))
    out = out if k is None else out.where(F.col(_RN) <= k)
    return out.withColumnRenamed(_RN, rank) if rank else out.drop(_RN)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def prefix_sum(df: DataFrame, keys: Sequence[str], position: str, value: Column, out: str, block: int = 1024) -> DataFrame:
    """Sum of `value` over the rows of the same key with a smaller integer `position`.

    Two levels: partial sums per (key, block of positions), a running sum over the blocks, and a
    running sum inside each block. The largest window partition is `block` positions or
    1/`block` of a key, so one very long key does not become one task's work.
    """
    blk = "__blk"
    rows = df.withColumn(blk, F.floor(F.col(position) / block)).withColumn("__v", value.cast("long"))
    sums = rows.groupBy(*keys, blk).agg(F.sum("__v").alias("__s"))
    over_blocks = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, blk, F.coalesce(F.sum("__s").over(over_blocks), F.lit(0)).alias("__base"))
    in_block = Window.partitionBy(*keys, blk).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__local", F.coalesce(F.sum("__v").over(in_block), F.lit(0)))
    joined = local.join(base, [*keys, blk])
    return joined.withColumn(out, F.col("__base") + F.col("__local")).drop(blk, "__v", "__local", "__base")


def dense_number(df: DataFrame, order: Sequence[str], out: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in the sorted order of `order` (a unique key), without a global sort task.

    Rows are range-partitioned; the partition number is frozen through a checkpoint so that a
    re-run task cannot renumber it; per-partition counts give each partition its first number.
    """
    part = "__part"
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn(part, F.spark_partition_id())
    ranged = checkpointed(ranged)
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    # one row per shuffle partition: bounded by the cluster's partition count, not by the data
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(part).orderBy(*order)
    numbered = ranged.withColumn("__i", F.row_number().over(inside)).join(base, part)
    return numbered.withColumn(out, F.col("__base") + F.col("__i") + F.lit(start - 1)).drop(part, "__i", "__base")
