"""Component scores, the overall score, gates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bands, ratio

#: Weights of the overall score.
WEIGHTS = {"label": 0.35, "duplicate": 0.20, "outlier": 0.15, "imbalance": 0.15, "bias": 0.15}


# The bands of the component scores below.


def label_score(errors: Column, n: Column, confidence: Column | None = None) -> Column:
    base = bands(ratio(errors, n), [(0.01, 95.0), (0.03, 85.0), (0.05, 75.0), (0.10, 60.0), (0.20, 40.0)], 20.0)
    return F.when((n == 0) | (errors == 0), F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), base if confidence is None else base - 10 * confidence))


def duplicate_score(pairs: Column, exact: Column, n: Column) -> Column:
    rate = ratio(F.least(1.5 * pairs, n), n) + 2 * ratio(exact, n)
    return F.when((n == 0) | (pairs == 0), F.lit(100.0)).otherwise(bands(rate, [(0.01, 98.0), (0.05, 90.0), (0.10, 80.0), (0.20, 65.0)], 50.0))


def outlier_score(outliers: Column, n: Column, expected: float = 0.1) -> Column:
    r = ratio(outliers, n)
    over = bands(r - expected, [(0.05, 75.0), (0.10, 60.0), (0.20, 45.0)], 30.0)
    return F.when((n == 0) | (outliers == 0), F.lit(100.0)).when(r <= expected, F.greatest(F.lit(85.0), 100 - 100 * r)).otherwise(over)


def imbalance_score(r: Column) -> Column:
    return bands(r, [(1.5, 100.0), (3.0, 90.0), (5.0, 80.0), (10.0, 65.0), (20.0, 50.0), (50.0, 35.0)], 20.0, strict=False)


def bias_score(issues: Column, parity_gap: Column, correlated: Column | None = None) -> Column:
    off = F.when(parity_gap > 0.3, 30.0).when(parity_gap > 0.2, 20.0).when(parity_gap > 0.1, 10.0).otherwise(0.0)
    off = off + (F.lit(0.0) if correlated is None else F.when(correlated, 15.0).otherwise(0.0)) + F.least(5.0 * issues, F.lit(30.0))
    return F.when(issues == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(20.0), 100 - off))


def overall(scores: dict[str, Column]) -> Column:
    """The weighted mean of the components given; weights are normalised, the sum rounded half to even."""
    total = sum(WEIGHTS[k] for k in scores)
    out = F.lit(0.0)
    for k, c in scores.items():
        out = out + c * F.lit(WEIGHTS[k] / total)
    return F.bround(out, 2)


def severity(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").when(score >= 40, "poor").otherwise("critical")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def size_bucket(n: Column) -> Column:
    return F.when(n < 1_000, "small").when(n < 10_000, "medium").when(n < 100_000, "large").otherwise("enterprise")


def row_score(outlier: Column, duplicate: Column, label_error: Column) -> Column:
    """Of a streamed row: 100 - 30 if an outlier - 20 if a repeat - 50 times the label score, not below 0."""
    return F.greatest(F.lit(0.0), 100 - F.when(outlier, 30.0).otherwise(0.0) - F.when(duplicate, 20.0).otherwise(0.0) - 50 * label_error)


def confusion(truth: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """Precision, recall, F1 and accuracy of found keys against true ones; 0 where undefined."""
    both = truth.select(key, F.lit(1).alias("t")).join(found.select(key, F.lit(1).alias("f")), key, "full")
    counts = both.agg(F.count_if(F.expr("t = 1 and f = 1")).alias("tp"), F.count_if(F.expr("t is null and f = 1")).alias("fp"), F.count_if(F.expr("t = 1 and f is null")).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    tn = F.lit(total) - F.col("tp") - F.col("fp") - F.col("fn")
    return counts.select("tp", "fp", "fn", tn.cast("long").alias("tn"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("tp") + tn, F.lit(total)).alias("accuracy"))


def regression_gate(metrics: DataFrame, thresholds: dict[str, tuple[float, float, bool]]) -> DataFrame:
    """metric, change, status of rows (metric, baseline, current). A threshold is (warning, critical, whether a rise is worse)."""
    rows = [(k, w, c, up) for k, (w, c, up) in thresholds.items()]
    limits = metrics.sparkSession.createDataFrame(rows, "metric string, warning double, critical double, up boolean")
    worse = F.when(F.col("up"), F.col("current") - F.col("baseline")).otherwise(F.col("baseline") - F.col("current"))
    status = F.when(worse >= F.col("critical"), "critical").when(worse >= F.col("warning"), "warning").otherwise("pass")
    return metrics.join(F.broadcast(limits), "metric").select("metric", (F.col("current") - F.col("baseline")).alias("change"), status.alias("status"))


def gates(measures: DataFrame, least_score: float = 80.0, most_duplicates: float = 0.05, most_missing: float = 0.1, most_outliers: float = 0.05) -> DataFrame:
    """Of one row (score, duplicate_rate, missing_rate, outlier_rate): a row a check with value, threshold, passed."""
    checks = [("score", F.col("score"), least_score, F.col("score") >= least_score), ("duplicates", F.col("duplicate_rate"), most_duplicates, F.col("duplicate_rate") <= most_duplicates), ("missing", F.col("missing_rate"), most_missing, F.col("missing_rate") <= most_missing), ("outliers", F.col("outlier_rate"), most_outliers, F.col("outlier_rate") <= most_outliers)]
    one = [F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), F.lit(t).alias("threshold"), p.alias("passed")) for n, v, t, p in checks]
    return measures.select(F.inline(F.array(*one)))
