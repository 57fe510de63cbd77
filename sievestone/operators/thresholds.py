"""Thresholds of a score chosen from one pass: counts in bins, summed up from above, folds held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio

METRICS = ("precision", "recall", "f1", "accuracy", "balanced")


def _measures(tp: Column, fp: Column, positives: Column, rows: Column) -> dict[str, Column]:
    fn, tn = positives - tp, rows - positives - fp
    p, r, s = ratio(tp, tp + fp), ratio(tp, positives), ratio(tn, rows - positives)
    return {"precision": p, "recall": r, "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, rows), "balanced": (r + s) / 2}


def binned(df: DataFrame, score: str, truth: str, cuts: list[float], fold: Column | None = None) -> DataFrame:
    """fold, bin, n, positives: counts of rows by how many cuts their score reaches; a row for each fold and bin. Null scores reach none, null truths are left out."""
    reached = F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(cuts))), lambda c: F.col(score) >= c)), F.lit(0))
    reached = F.when(F.col(score).isNull(), 0).otherwise(reached)
    y = F.col(truth).cast("int")
    return df.where(F.col(truth).isNotNull()).groupBy((F.lit(0) if fold is None else fold).alias("fold"), reached.alias("bin")).agg(F.count("*").alias("n"), F.sum(y).alias("positives"))


def _grid(counts: DataFrame, cuts: list[float], by: list[str]) -> DataFrame:
    """by, threshold, tp, fp, positives, rows at every cut, from bins; the tables have a row for each fold and cut."""
    every = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    levels = counts.sparkSession.createDataFrame([(i + 1, float(c)) for i, c in enumerate(sorted(cuts))], "level int, threshold double")
    full = every.crossJoin(F.broadcast(levels)) if by else levels
    same = F.lit(True)
    for c in by:
        same = same & (F.col(f"f.{c}") == F.col(f"c.{c}"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("positives").alias("all_positives"))
    met = full.alias("f").join(counts.alias("c"), same & (F.col("c.bin") >= F.col("f.level")), "left")
    sums = met.groupBy(*[F.col(f"f.{c}").alias(c) for c in by], "threshold").agg(F.coalesce(F.sum("c.positives"), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("c.n") - F.col("c.positives")), F.lit(0)).alias("fp"))
    return sums.join(total, by) if by else sums.crossJoin(total)


def threshold_grid(df: DataFrame, score: str, truth: str, cuts: list[float]) -> DataFrame:
    """threshold, precision, recall, f1, accuracy, balanced of flagging rows whose score is a threshold or more, for all thresholds from one scan."""
    g = _grid(binned(df, score, truth, cuts), cuts, [])
    m = _measures(F.col("tp"), F.col("fp"), F.col("all_positives"), F.col("rows"))
    return g.select("threshold", *[c.alias(k) for k, c in m.items()])


def cross_validated(df: DataFrame, score: str, truth: str, cuts: list[float], fold: Column, metric: str = "f1") -> DataFrame:
    """fold, threshold, train_score, test_score: of each fold the threshold that is best on all others (the smallest of several), and how it does on the fold; from one scan.

    The other folds' counts are the whole's less the fold's own.
    """
    own = _grid(binned(df, score, truth, cuts, fold), cuts, ["fold"])
    w = Window.partitionBy("threshold")  # a row for each fold
    rest = own.select("*", *[(F.sum(c).over(w) - F.col(c)).alias(f"other_{c}") for c in ("tp", "fp", "all_positives", "rows")])
    train = _measures(*[F.col(f"other_{c}") for c in ("tp", "fp", "all_positives", "rows")])[metric]
    test = _measures(*[F.col(c) for c in ("tp", "fp", "all_positives", "rows")])[metric]
    scored = rest.select("fold", "threshold", train.alias("train_score"), test.alias("test_score"))
    best = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc(F.round("train_score", 12)), "threshold"))
    return scored.withColumn("place", best).where("place = 1").drop("place")


def tuned(df: DataFrame, score: str, truth: str, cuts: list[float], fold: Column, metric: str = "f1") -> DataFrame:
    """One row: the threshold best on all rows, its score there, the mean score of held-out folds, and the spread of the folds' thresholds."""
    whole = threshold_grid(df, score, truth, cuts).select("threshold", F.col(metric).alias("score")).orderBy(F.desc(F.round("score", 12)), "threshold").limit(1)
    folds = cross_validated(df, score, truth, cuts, fold, metric).agg(F.avg("test_score").alias("held_out"), (F.max("threshold") - F.min("threshold")).alias("spread"))
    return whole.crossJoin(folds)
