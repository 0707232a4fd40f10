"""Streaming forms of the stateful operators: first-wins dedup, windowed label counts, run states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoints import checkpoint_dir


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table folder as a file stream; the schema comes from the table, never from inference per file."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Windows of a stream need a timestamp with time zone semantics; table timestamps have none."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def first_wins(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key over the whole stream. State holds every key seen, so the keys should have a scope that ends
    (a run, a document)."""
    return df.dropDuplicates(keys)


def windowed_counts(df: DataFrame, ts: str, width: str, keys: list[str]) -> DataFrame:
    """Counts per tumbling window and key. Nothing is late and no window stays back: drain with complete output."""
    out = df.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n")


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The latest row per key as a streaming aggregate: Spark keeps the state, a row per key."""
    rest = [c for c in columns if c not in order]
    return df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("s")).select(key, "s.*")


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over everything available and returns what it gave: all batches of an append stream, the last state of
    a complete one. A batch writes its own folder, so one that is run again changes nothing; an empty source gives an
    empty result."""
    spark = df.sparkSession
    place = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    done: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/batch-{batch_id}")
        done.append(batch_id)

    q = (df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    batches = sorted(set(done)) if mode == "append" else done[-1:]
    if not batches:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{place}/batch-{b}" for b in batches])
