"""Registry of catalogue queries: a name, a callable over the given tables and, where one exists, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


LARGE = {"documents", "conversations", "pages", "lineitem", "orders", "events"}


def spread(df: DataFrame) -> DataFrame:
    """A scan with far fewer splits than the cluster has cores (one small file) is redistributed once,
    so that per-row work runs on all cores. A large table has enough splits and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df.rdd.getNumPartitions()
    return df.repartition(cores) if size * 2 <= cores else df


class Tables:
    """Lazy access to the tables of a folder: t.lineitem, t.documents, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in LARGE else df


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
