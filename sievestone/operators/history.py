"""Snapshots of quality over time: trends, differences, rolling measures, ranks, costs, sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.ranges import lagged_steps, ranked

# Snapshot tables have a row a run or a version: windows over all of one are small. Windows over rows have partitions.


def trend(snapshots: DataFrame, order: str, metric: str, limit: int = 30) -> DataFrame:
    """n, slope (of the range, over n), r2, direction of the last ``limit`` snapshots."""
    last = snapshots.orderBy(F.desc(order)).limit(limit)
    ranked = last.withColumn("i", F.row_number().over(Window.orderBy(order)) - 1)
    one = ranked.agg(F.count("*").alias("n"), F.regr_slope(metric, "i").alias("s"), F.regr_r2(metric, "i").alias("r2"), (F.max(metric) - F.min(metric)).alias("range"))
    slope = ratio(F.col("s") * F.col("n"), F.col("range"))
    return one.select("n", slope.alias("slope"), "r2", F.when(slope > 0.1, "up").when(slope < -0.1, "down").otherwise("stable").alias("direction"))


def changes(snapshots: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """order, metric, value, delta, percent, change of every snapshot against the one before."""
    w = Window.orderBy(order)
    lagged = snapshots.select("*", *[F.lag(m).over(w).alias(f"__{m}") for m in metrics])
    rows = lagged.select(order, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"__{m}").cast("double").alias("before")) for m in metrics])))
    percent = 100 * ratio(F.col("value") - F.col("before"), F.abs("before"))
    return rows.where("before is not null").select(order, "metric", "value", (F.col("value") - F.col("before")).alias("delta"), percent.alias("percent"), F.when(percent > 1, "improved").when(percent < -1, "degraded").otherwise("unchanged").alias("change"))


def rolling(df: DataFrame, partition: list[str], order: str, flags: list[str], size: int = 1000) -> DataFrame:
    """The mean of each flag over a row and the rows before it, ``size`` in all, within partitions.

    Running sums up to a row, less those up to the row ``size`` before it; no
    task holds a partition. Null flags count in neither sum nor number.
    """
    number = lambda f: F.col(f).cast("double")
    sums = {f"{f}_sum": number(f) for f in flags} | {f"{f}_n": number(f).isNotNull().cast("long") for f in flags}
    rows = ranked(df.select(*partition, order, *flags), partition, order, "rank", sums)
    before = rows.select(*[F.col(c).alias(f"{c}_b") for c in partition], (F.col("rank") + size).alias("rank_b"), *[F.col(c).alias(f"{c}_b") for c in sums])
    joined = rows.join(before, reduce(Column.__and__, [rows[c].eqNullSafe(before[f"{c}_b"]) for c in partition], rows["rank"] == before["rank_b"]), "left")
    less = lambda c: F.col(c) - F.coalesce(F.col(f"{c}_b"), F.lit(0))
    return joined.select(*partition, order, *[(less(f"{f}_sum") / F.when(less(f"{f}_n") > 0, less(f"{f}_n"))).alias(f"{f}_rate") for f in flags])


def steps(df: DataFrame, column: str, order: str, partition: list[str] = ()) -> DataFrame:
    """Whether a column rises by one constant step in the order, and the step."""
    d = lagged_steps(df, list(partition), order, column)
    return (d.groupBy(*partition) if partition else d).agg((F.count_distinct("step") == 1).alias("sequential"), F.min("step").alias("step"))


def leaderboard(df: DataFrame, name: str, score: str, top: int = 10) -> DataFrame:
    """name, score, rank, percentile of the best ``top``: the share of entries strictly below; null scores count as entries, below none."""
    best = df.select(name, score).orderBy(F.desc(score), name).limit(top).collect()
    if not best:
        return df.select(name, score, F.lit(0).alias("rank"), F.lit(0.0).alias("percentile")).limit(0)
    below = [F.count_if(F.col(score) < F.lit(r[1])) if r[1] is not None else F.lit(0) for r in best]
    rows = [F.struct(F.lit(r[0]).alias(name), F.lit(r[1]).cast(df.schema[score].dataType).alias(score), F.lit(i + 1).alias("rank"), (100 * b / F.count("*")).alias("percentile")) for i, (r, b) in enumerate(zip(best, below, strict=True))]
    return df.agg(F.array(*rows).alias("all")).select(F.inline("all"))


def percentiles(df: DataFrame, group: str, score: str) -> DataFrame:
    """Per group of three scores or more: mean, deviation, p10 to p99, by rank, so that no task holds a group; null scores are left out."""
    points = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    scored = df.select(group, F.col(score).cast("double").alias("score")).where("score is not null")
    g = scored.groupBy(group).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")).where("n >= 3")
    wanted = g.select(F.col(group).alias("group_key"), F.explode(F.array(*[F.struct(F.lit(p).alias("p"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for p in points])).alias("w")).select("group_key", "w.p", "w.at")
    rows = ranked(scored, [group], "score", "rank")
    near = (F.col("rank") - 1 == F.floor("at")) | (F.col("rank") - 1 == F.ceil("at"))
    met = rows.join(F.broadcast(wanted), rows[group].eqNullSafe(wanted["group_key"]) & near) if wanted.limit(10_001).count() <= 10_000 else rows.join(wanted, rows[group].eqNullSafe(wanted["group_key"]) & near)
    low, high, share = F.min("score"), F.max("score"), F.max(F.col("at") - F.floor("at"))
    q = met.groupBy("group_key").pivot("p", points).agg((low + (high - low) * share).alias("q"))
    joined = g.join(q, g[group].eqNullSafe(q["group_key"]))
    return joined.select(group, "n", "mean", "std", *[F.col(f"`{p}`").alias(f"p{int(p * 100)}") for p in points])


def degradation(scores: DataFrame, order: str, score: str, first: int = 10, last: int = 10, threshold: float = 0.05) -> DataFrame:
    """baseline (mean of the first), recent (of the last), drop, degraded."""
    n = F.count("*").over(Window.partitionBy())
    r = scores.select(F.row_number().over(Window.orderBy(order)).alias("i"), n.alias("n"), F.col(score).alias("s"))
    one = r.agg(F.avg(F.when(F.col("i") <= first, F.col("s"))).alias("baseline"), F.avg(F.when(F.col("i") > F.col("n") - last, F.col("s"))).alias("recent"))
    drop = ratio(F.col("baseline") - F.col("recent"), F.col("baseline"))
    return one.select("baseline", "recent", drop.alias("drop"), (drop > threshold).alias("degraded"))


def last_decisions(events: DataFrame, item: str, decision: str, ts: str) -> DataFrame:
    return events.groupBy(item).agg(F.max_by(decision, ts).alias("decision"), F.count("*").alias("events"))


def detector_comparison(runs: DataFrame, detector: str, metrics: list[str]) -> DataFrame:
    """Per detector: runs, and the mean and sample deviation of every metric."""
    return runs.groupBy(detector).agg(F.count("*").alias("runs"), *[f(m).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("std", F.stddev_samp))])


def feedback_correlation(df: DataFrame, flags: list[str], error: str) -> DataFrame:
    """issue, correlation with the error, effect: mean error with the issue less without."""
    e = F.col(error).cast("double")
    one = [F.struct(F.lit(f).alias("issue"), F.corr(F.col(f).cast("double"), e).alias("correlation"), (F.avg(F.when(F.col(f).cast("int") == 1, e)) - F.avg(F.when(F.col(f).cast("int") == 0, e))).alias("effect")) for f in flags]
    return df.agg(F.array(*one).alias("all")).select(F.inline("all"))


def site_reports(df: DataFrame, site: str, label: str, columns: list[str]) -> DataFrame:
    """Per site: rows, missing and duplicate rates, class ratio, score = 100 - 30 missing - 20 repeated - {15, 10, 5} for ratios over 10, 5, 2."""
    missing = reduce(Column.__add__, [F.avg(F.col(c).isNull().cast("int")) for c in columns]) / len(columns)
    a = df.groupBy(site).agg(F.count("*").alias("rows"), missing.alias("missing_rate"))
    b = df.groupBy(site, *columns).count().groupBy(site).agg((1 - F.count("*") / F.sum("count")).alias("duplicate_rate"))
    c = df.groupBy(site, label).count().groupBy(site).agg((F.max("count") / F.min("count")).alias("class_ratio"))
    off = F.when(F.col("class_ratio") > 10, 15.0).when(F.col("class_ratio") > 5, 10.0).when(F.col("class_ratio") > 2, 5.0).otherwise(0.0)
    return a.join(b, site).join(c, site).withColumn("score", F.greatest(F.lit(0.0), 100 - 30 * F.col("missing_rate") - 20 * F.col("duplicate_rate") - off))


def pooled(sites: DataFrame, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """One row over sites: rows and means weighted by rows, with Laplace noise of a scale, if asked for."""
    weighted = lambda c: F.sum(F.col(c) * F.col("rows")) / F.sum("rows")
    one = sites.agg(F.sum("rows").alias("rows"), *[weighted(c).alias(c) for c in ("missing_rate", "duplicate_rate", "score")])
    if not noise:
        return one
    draw = lambda i: F.rand(seed + i) - 0.5
    return one.select("rows", *[(F.col(c) - noise * F.signum(draw(i)) * F.ln(1 - 2 * F.abs(draw(i)))).alias(c) for i, c in enumerate(("missing_rate", "duplicate_rate", "score"))])


def cost_impact(counts: DataFrame, labelling: float = 0.10, review: float = 0.05, expert: float = 0.25) -> DataFrame:
    """Of rows (kind, n): cost of fixing and expected gain, each gain capped at 1."""
    gains = counts.sparkSession.createDataFrame([("label_error", labelling + expert, 0.03), ("duplicate", 0.0, 0.01), ("outlier", review, 0.005), ("imbalance", 0.0, 0.02), ("missing", review, 0.01)], "kind string, unit double, gain double")
    return counts.join(F.broadcast(gains), "kind").select("kind", "n", (F.col("n") * F.col("unit")).alias("cost"), F.when(F.col("n") > 0, F.col("gain")).otherwise(0.0).alias("gain"))


def compliance(scores: DataFrame, requirements: list[tuple[str, str]]) -> DataFrame:
    """requirement, component, score, status (80 compliant, 50 partial) from one row of component scores."""
    table = F.array(*[F.struct(F.lit(r).alias("requirement"), F.lit(c).alias("component"), F.col(c).cast("double").alias("score")) for r, c in requirements])
    return scores.select(F.inline(table)).withColumn("status", F.when(F.col("score") >= 80, "compliant").when(F.col("score") >= 50, "partial").otherwise("non_compliant"))
