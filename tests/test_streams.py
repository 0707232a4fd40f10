"""Streaming forms over several unordered files, one per batch, and over an empty folder."""

from pyspark.sql import functions as F

from factweave.streaming import streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


def stream(spark, folder):
    schema = spark.read.parquet(EVENTS).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def forms(df):
    timed = streams.event_time(df)
    latest = streams.latest(df.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], ["ts", "event_id", "event_type"])
    return [
        (streams.first_wins(timed, ["user_id", "event_type"]).select("user_id", "event_type"), "append"),
        (streams.windowed_counts(timed, "ts", "1 hour", ["event_type"]), "complete"), (latest, "complete"),
    ]


def test_six_files_give_what_one_table_gives(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    for i in range(6):
        batch.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for (df, mode), (want, _) in zip(forms(stream(spark, tmp_path / "in")), forms(batch)):
        got = sorted(map(tuple, streams.drain(df, mode).collect()), key=repr)
        assert got == sorted(map(tuple, want.collect()), key=repr)


def test_an_empty_folder_gives_no_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    for df, mode in forms(stream(spark, tmp_path / "none")):
        assert streams.drain(df, mode).count() == 0
