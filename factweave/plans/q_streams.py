"""Catalogue: streaming forms over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams
from .registry import query


@query("stream_first_wins", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_wins(t):
    """Statement keys arriving as a stream, each kept once."""
    df = streams.event_time(streams.read_stream(t.spark, t.folder, "events"))
    return streams.drain(streams.first_wins(df, ["user_id", "event_type"]).select("user_id", "event_type"))


@query("stream_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(t):
    """Hourly label counts of all events, in whatever order they arrive."""
    df = streams.event_time(streams.read_stream(t.spark, t.folder, "events"))
    out = streams.drain(streams.windowed_counts(df, "ts", "1 hour", ["event_type"]), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_latest_runs", "SELECT user_id AS run_id, max(ts) AS ts, max(event_id) FILTER (event_id = m) AS event_id, max(event_type) FILTER (event_id = m) AS status FROM (SELECT *, arg_max(event_id, (ts, event_id)) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY 1")
def stream_latest_runs(t):
    """Run states kept up to date batch by batch."""
    df = streams.read_stream(t.spark, t.folder, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.col("event_type").alias("status"))
    return streams.drain(streams.latest(df, "run_id", ["ts", "event_id"], ["ts", "event_id", "status"]), "complete")
