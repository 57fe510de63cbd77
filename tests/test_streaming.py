"""Streams give what batches give."""

from pyspark.sql import functions as F

from sievestone.sources import tables
from sievestone.streaming import live

SF = "/root/testdata/sf0.001"


def events(spark, folder):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(3, "ts").write.mode("overwrite").parquet(folder)
    return rows, tables.stream(spark, "parquet", rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), path=folder, maxFilesPerTrigger="1")


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows(spark, tmp_path):
    rows, stream = events(spark, str(tmp_path / "a"))
    want = live.tumbling(rows, "ts", "1 day", ["event_type"], "value")
    got = run(live.tumbling(stream, "ts", "1 day", ["event_type"], "value", late="1 day"), "windows", "complete")
    key = lambda df: {(r.start, r.event_type, r.n) for r in df.collect()}
    assert key(got) == key(want)


def test_repeats(spark, tmp_path):
    rows, _ = events(spark, str(tmp_path / "b"))
    doubled = rows.union(rows)
    doubled.coalesce(1).write.parquet(str(tmp_path / "c"))
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    stream = tables.stream(spark, "parquet", schema, path=str(tmp_path / "c"))
    assert run(live.without_repeats(stream, ["event_id"], "ts", "60 days"), "once", "append").count() == rows.count()
    flagged = run(live.flag_repeats(stream, ["event_id", "event_type"], "event_id", keep=100_000, groups=2), "flags", "append")
    assert flagged.where("is_duplicate").count() == rows.count()


def test_monitor(spark, tmp_path):
    batch = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 0), (4.0, 0), (100.0, 0)], "feature double, label int")
    sent, now = [], [0.0]
    monitor = live.Monitor(str(tmp_path / "m"), ["feature"], "label", send=sent.append, clock=lambda: now[0])
    monitor(batch, 0)
    monitor(batch, 1)
    assert [a["issue"] for a in sent] == ["outliers"]  # the second waits for the cool-down
    now[0] = 61.0
    monitor(batch, 2)
    assert len(sent) == 2
    checked = {r.feature: r.is_outlier for r in live.check_batch(batch, ["feature"], "label").collect()}
    assert checked[100.0] and not checked[4.0]
    assert "quality_x 1" in live.prometheus({"x": 1})
