"""Result cache, run log and feedback tables as plain DataFrames over files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ranking import first_per_key

TTL_HOURS = 24


def cache_key(text: Column, canonical: Column) -> Column:
    return F.sha2(F.concat(text, F.lit(":canonical="), F.when(canonical, "true").otherwise("false")), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, key: str = "input_hash", created: str = "created_at") -> DataFrame:
    """Requests with the newest cache entry not older than 24 hours (null = miss)."""
    live = cache.where(F.col(created) >= now - F.expr(f"interval {TTL_HOURS} hours"))
    rest = [c for c in cache.columns if c not in (key, created)]
    newest = live.groupBy(key).agg(F.max(F.struct(created, *rest)).alias("c")).select(key, "c.*")
    return requests.join(newest, key, "left")


def cache_upsert(cache: DataFrame, fresh: DataFrame, key: str = "input_hash", created: str = "created_at", size: str = "n_statements") -> DataFrame:
    """Cache after storing fresh results: empty results are never stored, the newest entry wins."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(fresh.where(F.col(size) > 0).withColumn("__new", F.lit(1)))
    rest = [c for c in cache.columns if c not in (key, created)]
    newest = both.groupBy(key).agg(F.max(F.struct("__new", created, *rest)).alias("c"))
    return newest.select(key, "c.*").drop("__new")


def cache_cleanup(cache: DataFrame, now: Column, created: str = "created_at") -> DataFrame:
    """What stays after the expired entries are deleted."""
    return cache.where(F.col(created) >= now - F.expr(f"interval {TTL_HOURS} hours"))


def latest_runs(log: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Current state of each run from an append-only log: last status, first and completion time."""
    last = F.max_by("status", F.struct(*order))
    return log.groupBy(run).agg(
        last.alias("status"), F.min("ts").alias("created_at"),
        F.max(F.when(F.col("status").isin("succeeded", "failed"), F.col("ts"))).alias("completed_at"),
        F.count(F.lit(1)).alias("updates"))


def run_error(log: DataFrame, run: str, order: list[Column]) -> DataFrame:
    return first_per_key(log.where(F.col("status") == "failed"), [run], order)


def feedback_rows(df: DataFrame, text: str = "source_text", xml: str = "output_xml", n: str = "num_statements", source: str = "source") -> DataFrame:
    """Rows for the feedback table: input wrapped as a page, unknown sources become "correction"."""
    kind = F.when(F.col(source).isin("upload", "correction", "liked"), F.col(source)).otherwise("correction")
    return df.select(F.concat(F.lit("<page>"), F.col(text), F.lit("</page>")).alias("input_text"), F.col(xml).alias("output_xml"),
                     F.col(n).alias("num_statements"), F.lit(None).cast("boolean").alias("accepted"), kind.alias("source"))


_LINE = "input string, output string, num_statements int, broken string"


def training_lines(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """JSON lines of training data (input, output, num_statements) as rows of the feedback table, accepted and without a
    user; `broken` holds a line that is no such object (neither JSON with both texts), all else of its row is null. Blank lines are
    skipped; columns named in `keep` are carried along."""
    line = F.col(value)
    parsed = lines.where(tx.strip(line) != "").select(*keep, line.alias("__line"), F.from_json(line, _LINE, {"columnNameOfCorruptRecord": "broken"}).alias("d"))
    fine = F.col("d.broken").isNull() & F.col("d.input").isNotNull() & F.col("d.output").isNotNull()
    only = lambda c: F.when(fine, c)
    return parsed.select(
        *keep, only(F.col("d.input")).alias("input_text"), only(F.col("d.output")).alias("output_xml"), only(F.coalesce("d.num_statements", F.lit(0))).alias("num_statements"),
        only(F.lit(True)).alias("accepted"), F.lit(None).cast("string").alias("user_uuid"), F.when(~F.coalesce(fine, F.lit(False)), F.col("__line")).alias("broken"))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """`training_lines` of the JSONL files at path."""
    return training_lines(spark.read.text(path))


def write_training(rows: DataFrame, path: str) -> None:
    """The rows that are not broken as JSONL files that `read_training` reads back."""
    rows.where(F.col("broken").isNull()).select(F.col("input_text").alias("input"), F.col("output_xml").alias("output"), "num_statements").write.mode("append").json(path)


def accepted_text(c: Column, limit: int = 10_000) -> Column:
    """Requests longer than the service limit are refused, not cut."""
    return F.length(tx.strip(c)).between(1, limit)
