"""Live quality of a stream: per-batch checks, repeats within a horizon, rolling measures, alerts, event-time windows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import row_hash
from ..functions.quantiles import quantiles
from ..operators.history import rolling
from ..operators.scores import row_score


def check_batch(batch: DataFrame, numbers: list[str], label: str | None = None, flagged: str | None = None) -> DataFrame:
    """The batch with is_outlier (its own IQR fences, any number), label_score and quality.

    label_score is 1 / (1 + exp(-.5 (d - 2))), d the distance to the centroid of
    the row's class in the batch over the class's mean deviation; 0 for classes
    of one row. ``flagged`` names a column that tells repeats, if there is one.
    """
    rows, out = batch, F.lit(False)
    for c, (q1, q3) in quantiles(batch, numbers, [0.25, 0.75]).items():
        if q1 is None:
            continue
        out = out | F.coalesce((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1)), F.lit(False))
    score = F.lit(0.0)
    if label and numbers:
        g = batch.groupBy(label).agg(F.count("*").alias("__n"), *[F.avg(c).alias(f"__m_{c}") for c in numbers], *[F.stddev_pop(c).alias(f"__s_{c}") for c in numbers])
        rows = rows.join(F.broadcast(g), label, "left")
        far = F.sqrt(sum(((F.col(c) - F.col(f"__m_{c}")) * (F.col(c) - F.col(f"__m_{c}")) for c in numbers), F.lit(0.0)))
        spread = sum((F.col(f"__s_{c}") for c in numbers), F.lit(0.0)) / len(numbers)
        d = far / F.when(spread > 0, spread)
        score = F.when(F.col("__n") >= 2, F.coalesce(1 / (1 + F.exp(-0.5 * (d - 2))), F.lit(0.0))).otherwise(0.0)
    repeat = F.col(flagged) if flagged else F.lit(False)
    return rows.withColumns({"is_outlier": out, "label_score": score}).select(*batch.columns, "is_outlier", "label_score", row_score(F.col("is_outlier"), repeat, F.col("label_score")).alias("quality"))


def without_repeats(stream: DataFrame, columns: list[str], ts: str, horizon: str = "1 hour") -> DataFrame:
    """The stream without rows equal to one within the horizon of event time."""
    return stream.withColumn("__h", row_hash(columns)).withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["__h"]).drop("__h")


def flag_repeats(stream: DataFrame, columns: list[str], key: str, keep: int = 10_000, groups: int = 64):
    """key, is_duplicate: whether an equal row came among the last distinct ones of its hash group.

    Hashes are dealt into groups, each with a bounded state of ``keep / groups``
    hashes in order of arrival; what is older is forgotten.
    """
    hashed = stream.select(F.col(key).cast("long").alias("key"), row_hash(columns).alias("h")).withColumn("g", F.pmod(F.xxhash64("h"), F.lit(groups)))
    most = max(1, keep // groups)

    def step(g, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = dict.fromkeys(state.get[0].split(",") if state.exists and state.get[0] else [])
        for pdf in batches:
            flags = []
            for h in pdf.sort_values("key")["h"]:
                flags.append(h in seen)
                if h not in seen:
                    seen[h] = None
                    if len(seen) > most:
                        del seen[next(iter(seen))]
            yield pd.DataFrame({"key": pdf.sort_values("key")["key"], "is_duplicate": flags})
        state.update((",".join(seen),))

    return hashed.groupBy("g").applyInPandasWithState(step, "key long, is_duplicate boolean", "seen string", "append", "NoTimeout")


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """start, keys, n, total over windows of event time; on a stream ``late`` is how long late rows are waited for."""
    rows = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """key, start, end, n: runs of events with no pause of ``gap``."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rolling_quality(scored: DataFrame, order: str, partition: str, size: int = 1000) -> DataFrame:
    """Rates of outliers and repeats and mean quality over the last rows of each partition, from running sums, so that no task holds a partition."""
    rows = scored.select(partition, order, F.col("is_outlier").cast("int").alias("outlier"), F.col("is_duplicate").cast("int").alias("duplicate"), "quality")
    rated = rolling(rows, [partition], order, ["outlier", "duplicate", "quality"], size)
    return rated.select(partition, order, "outlier_rate", "duplicate_rate", F.col("quality_rate").alias("quality"))


def alerts(measures: DataFrame) -> DataFrame:
    """severity, issue, value of one row of measures that breaks a limit: outliers over .1, repeats over .05, quality under 70."""
    checks = [("warning", "outliers", F.col("outlier_rate"), F.col("outlier_rate") > 0.1), ("warning", "duplicates", F.col("duplicate_rate"), F.col("duplicate_rate") > 0.05), ("critical", "quality", F.col("quality"), F.col("quality") < 70)]
    return measures.select(F.inline(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(s).alias("severity"), F.lit(i).alias("issue"), v.cast("double").alias("value"))) for s, i, v, t in checks]))))


class Monitor:
    """``foreachBatch`` sink: checks every batch, appends its measures to a table, sends alerts at most once a cool-down."""

    def __init__(self, folder: str, numbers: list[str], label: str | None = None, key_columns: list[str] | None = None, cool_down: float = 60.0, send: Callable[[dict], None] | None = None, clock: Callable[[], float] = time.time):
        self.folder, self.numbers, self.label, self.columns = folder, numbers, label, key_columns
        self.cool_down, self.send, self.clock = cool_down, send or (lambda alert: None), clock
        self.last: dict[str, float] = {}

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch
        if self.columns:
            w = Window.partitionBy(row_hash(self.columns)).orderBy(*self.columns)
            rows = batch.withColumn("is_duplicate", F.row_number().over(w) > 1)
        else:
            rows = batch.withColumn("is_duplicate", F.lit(False))
        scored = check_batch(rows, self.numbers, self.label, "is_duplicate")
        measures = scored.agg(F.lit(number).alias("batch"), F.count("*").alias("rows"), F.avg(F.col("is_outlier").cast("int")).alias("outlier_rate"), F.avg(F.col("is_duplicate").cast("int")).alias("duplicate_rate"), F.avg("quality").alias("quality"))
        path = f"{self.folder}/batch={number}"
        measures.drop("batch").write.mode("overwrite").parquet(path)  # a batch that runs again replaces itself
        for alert in alerts(batch.sparkSession.read.parquet(path)).collect():
            now = self.clock()
            if now - self.last.get(alert["issue"], -1e18) >= self.cool_down:
                self.last[alert["issue"]] = now
                self.send(alert.asDict())


def prometheus(measures: dict[str, float], prefix: str = "quality") -> str:
    """Measures in the text format of metric scrapers."""
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v}\n" for k, v in measures.items())
