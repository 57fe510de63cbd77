"""Count windows on a stream give what the batch operator gives, through a restart."""

import math
import time

from pyspark.sql import functions as F

from sievestone.operators import history
from sievestone.sources import tables
from sievestone.streaming import windows

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_through_a_restart(spark, tmp_path):
    for k, v in windows.STORE.items():
        spark.conf.set(k, v)
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", F.when(F.col("event_id") % 11 != 0, (F.col("value") > 60).cast("double")).alias("high"), (F.col("user_id") % 3 == 0).cast("double").alias("third"))
    rows = rows.withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type")))
    folder = str(tmp_path / "in")
    parts = [rows.where(F.col("event_id") < 400), rows.where(F.col("event_id").between(400, 699)), rows.where(F.col("event_id") >= 700)]
    schema = "event_id long, event_type string, high double, third double"

    def drain():
        stream = tables.stream(spark, "parquet", schema, path=folder)
        rated = windows.rolling_rates(stream, "event_type", "event_id", ["high", "third"], size=50)
        q = rated.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None

    for part in parts:  # each run starts anew from the checkpoint
        part.coalesce(1).write.mode("append").parquet(folder)
        drain()
    got = {r.event_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = history.rolling(rows, ["event_type"], "event_id", ["high", "third"], size=50).collect()
    assert len(got) == len(want)
    same = lambda a, b: (a is None or math.isnan(a)) and b is None or a is not None and b is not None and math.isclose(a, b, abs_tol=1e-9)
    assert all(got[r.event_id].key == r.event_type and same(got[r.event_id].high_rate, r.high_rate) and same(got[r.event_id].third_rate, r.third_rate) for r in want)
    rated = spark.read.parquet(str(tmp_path / "out"))
    numbers = rated.groupBy("key").agg(F.count("*").alias("n"), F.max("number").alias("most")).collect()
    assert all(r.n == r.most for r in numbers)
    chunks = windows.chunk_measures(rated, 100).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in chunks} == {r.key: r.n // 100 for r in numbers if r.n >= 100}


def test_idle_keys_start_anew(spark, tmp_path):
    for k, v in windows.STORE.items():
        spark.conf.set(k, v)
    rows = spark.createDataFrame([(i, "a", float(i % 2)) for i in range(6)], "event_id long, event_type string, high double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tables.stream(spark, "parquet", "event_id long, event_type string, high double", path=str(tmp_path / "in"))
    rated = windows.rolling_rates(stream, "event_type", "event_id", ["high"], size=4, idle_ms=2000)
    q = rated.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="1 second").start()
    seen = lambda n: any(spark.table("idle").count() >= n or time.sleep(1) for _ in range(60))
    try:
        assert seen(6)
        time.sleep(6)  # the timer fires in batches without rows
        rows.withColumn("event_id", F.col("event_id") + 100).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert seen(12)
        got = {r.event_id: r for r in spark.table("idle").collect()}
    finally:
        q.stop()
    assert [got[i].number for i in (0, 5, 100, 105)] == [1, 6, 1, 6]
    assert [got[i].high_rate for i in (0, 1, 3, 4, 100)] == [0.0, 0.5, 0.5, 0.5, 0.0]
