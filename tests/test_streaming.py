"""Streams give what tables give."""

import datetime

from pyspark.sql import functions as F

from spandrel.operators import parse
from tests import samples
from spandrel.sources import files
from spandrel.streaming import watch


def test_bursts_of_a_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    minutes = [0, 1, 2, 20, 40, 41, 300]
    rows = spark.createDataFrame([(1, start + datetime.timedelta(minutes=m)) for m in minutes], "k int, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = watch.bursts(rows, "ts", "5 minutes", ["k"])
    assert sorted(r.events for r in batch.collect()) == [1, 1, 2, 3]
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
    query = watch.bursts(stream, "ts", "5 minutes", ["k"]).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    closed = sorted(r.events for r in spark.table("bursts").collect())
    assert closed == [1, 2, 3]  # the last burst is still open


def test_gap_boundary(spark):
    rows = spark.sql("select 1 k, timestamp'2024-01-01 00:00:00' ts union all select 1, timestamp'2024-01-01 00:05:00' union all select 1, timestamp'2024-01-01 00:10:01'")
    assert sorted(r.events for r in watch.bursts(rows, "ts", "5 minutes", ["k"]).collect()) == [1, 2]


def test_refresh_parses_only_what_changed(spark):
    now = files.captured(spark, samples.FILES).withColumn("version", F.length("content"))
    old = parse.parse_modules(now.limit(1)).join(now.select("path", "version"), "path")
    parsed = []

    def again(df):
        parsed.extend(r.path for r in df.collect())
        return parse.parse_modules(df).join(df.select("path", "version"), "path")

    out = watch.refresh(now, old, ["path", "version"], again)
    assert out.count() == 2 and len(parsed) == 1


def test_watch_goes_on_after_a_failure(spark, tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    (folder / "a.py").write_text("x = 1\n")
    (folder / "a.md").write_text("no\n")
    seen = []

    def regenerate(df, number):
        seen.extend(r.path.rsplit("/", 1)[-1] for r in df.collect())
        raise RuntimeError

    query = watch.watch(spark, str(folder), regenerate, str(tmp_path / "cp"), once=True)
    query.awaitTermination(120)
    assert query.exception() is None and seen == ["a.py"]
