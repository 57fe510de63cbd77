"""Distribution drift between a reference and a current table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pvalues import chi2_p, ks_p


def _tagged(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    rows = reference.select(F.col(column).cast("double").alias("x"), F.lit(1).alias("r")).unionByName(current.select(F.col(column).cast("double").alias("x"), F.lit(0).alias("r")))
    return rows.where("x is not null")


def cumulative(reference: DataFrame, current: DataFrame, column: str, ranges: int = 64) -> DataFrame:
    """x, next, f, g: both distribution functions at every distinct value, and the value after it.

    Distinct values with counts are dealt into ranges by approximate quantiles;
    sums over the ranges before each are added to running sums within it, so no
    window holds the whole column.
    """
    counts = _tagged(reference, current, column).groupBy("x").agg(F.sum("r").alias("a"), F.sum(1 - F.col("r")).alias("b"))
    cuts = sorted(set(counts.agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []))
    part = reduce(lambda c, i: F.when(F.col("x") > cuts[i], i + 1).otherwise(c), range(len(cuts)), F.lit(0)) if cuts else F.lit(0)
    placed = counts.withColumn("part", part)
    sums = placed.groupBy("part").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.min("x").alias("least"))
    w = Window.orderBy("part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("pa"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("pb"), F.lead("least").over(w).alias("after"), F.sum("sa").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"), F.sum("sb").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))  # at most ``ranges`` rows
    own = Window.partitionBy("part").orderBy("x")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(sums), "part")
    return joined.select("x", F.coalesce(F.lead("x").over(own), "after").alias("next"), ((F.col("pa") + F.sum("a").over(run)) / F.col("n")).alias("f"), ((F.col("pb") + F.sum("b").over(run)) / F.col("m")).alias("g"), "n", "m")


def numeric_drift(reference: DataFrame, current: DataFrame, column: str, threshold: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """feature, ks, p_value, wasserstein (over the pooled range), has_drift."""
    c = cumulative(reference, current, column)
    gap = F.abs(F.col("f") - F.col("g"))
    one = c.agg(F.max(gap).alias("ks"), (F.sum(gap * (F.coalesce("next", "x") - F.col("x"))) / F.when(F.max("x") > F.min("x"), F.max("x") - F.min("x"))).alias("wasserstein"), F.max("n").alias("n"), F.max("m").alias("m"))
    one = one.withColumn("p_value", ks_p("ks", "n", "m"))
    return one.select(F.lit(column).alias("feature"), "ks", "p_value", F.coalesce("wasserstein", F.lit(0.0)).alias("wasserstein"), ((F.col("p_value") < alpha) | (F.col("ks") > threshold)).alias("has_drift"))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index over equal bins of the reference's range; current values outside it are left out."""
    low, high = reference.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    x = F.col("x")
    width = (high - low) / bins if high is not None and high > low else 1.0
    low = 0.0 if low is None else low
    cell = F.least(F.lit(bins - 1), F.floor((x - low) / width)).cast("int")
    rows = _tagged(reference, current, column).where((x >= low) & (x <= (high if high is not None else 0.0))).groupBy(cell.alias("bin")).agg(F.sum("r").alias("a"), F.sum(1 - F.col("r")).alias("b"))
    every = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(rows, "bin", "left").select("bin", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return _psi(full, column, floor)


def _psi(full: DataFrame, column: str, floor: float) -> DataFrame:
    total = full.agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    p = F.greatest(F.col("a") / F.greatest("n", F.lit(1)), F.lit(floor))
    q = F.greatest(F.col("b") / F.greatest("m", F.lit(1)), F.lit(floor))
    return full.crossJoin(F.broadcast(total)).agg(F.lit(column).alias("feature"), F.sum((q - p) * F.ln(q / p)).alias("psi"))


def category_counts(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """value, a, b: counts in both tables of every category of either."""
    rows = reference.select(F.col(column).alias("value"), F.lit(1).alias("r")).unionByName(current.select(F.col(column).alias("value"), F.lit(0).alias("r")))
    return rows.where("value is not null").groupBy("value").agg(F.sum("r").alias("a"), F.sum(1 - F.col("r")).alias("b"))


def categorical_psi(reference: DataFrame, current: DataFrame, column: str, floor: float = 1e-4) -> DataFrame:
    return _psi(category_counts(reference, current, column), column, floor)


def categorical_drift(reference: DataFrame, current: DataFrame, column: str, threshold: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """feature, chi2, p_value, score, has_drift on frequencies scaled to 1000; score is chi2 / 1000, infinite for a category new in the current table."""
    counts = category_counts(reference, current, column)
    total = counts.agg(F.sum("a").alias("n"), F.sum("b").alias("m"), F.count("*").alias("k"))
    e, o = 1000 * F.col("a") / F.col("n"), 1000 * F.col("b") / F.col("m")
    term = F.when(e > 0, (o - e) * (o - e) / F.when(e > 0, e)).otherwise(F.when(o > 0, F.lit(float("inf"))).otherwise(0.0))
    one = counts.crossJoin(F.broadcast(total)).agg(F.sum(term).alias("chi2"), F.max("k").alias("k"))
    one = one.withColumn("p_value", F.when(F.col("chi2") == float("inf"), 0.0).otherwise(chi2_p("chi2", F.greatest(F.col("k") - 1, F.lit(1)).cast("double"))))
    return one.select(F.lit(column).alias("feature"), "chi2", "p_value", (F.col("chi2") / 1000).alias("score"), ((F.col("p_value") < alpha) | (F.col("chi2") / 1000 > threshold)).alias("has_drift"))


def monitor(reference: DataFrame, batches: DataFrame, batch: str, categories: list[str], alert_at: float = 0.1, floor: float = 1e-4) -> DataFrame:
    """batch, feature, psi, severity, alert of every appended batch against the reference, in one pass over all batches.

    Categories of either side count; null ones are left out. A batch without
    values of a feature has no row for it.
    """
    out = []
    for c in categories:
        p = reference.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("a"))
        q = batches.where(F.col(c).isNotNull()).groupBy(F.col(batch).alias("batch"), F.col(c).alias("value")).agg(F.count("*").alias("b"))
        every = q.select("batch").distinct().crossJoin(p.select("value").union(q.select("value")).distinct())  # batches times categories, both few
        full = every.join(p, "value", "left").join(q, ["batch", "value"], "left").na.fill(0, ["a", "b"])
        total = full.groupBy("batch").agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
        x, y = F.greatest(F.col("a") / F.greatest("n", F.lit(1)), F.lit(floor)), F.greatest(F.col("b") / F.greatest("m", F.lit(1)), F.lit(floor))
        out.append(full.join(total, "batch").groupBy("batch").agg(F.sum((y - x) * F.ln(y / x)).alias("psi")).select("batch", F.lit(c).alias("feature"), "psi"))
    return reduce(DataFrame.unionByName, out).withColumns({"severity": severity(F.col("psi")), "alert": F.col("psi") >= alert_at})


def reference_bins(reference: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """feature, low, width, bin, a: equal bins over the reference's range of each column, with its counts; empty bins have a row too."""
    row = reference.agg(*[F.struct(F.min(c).cast("double"), F.max(c).cast("double")).alias(c) for c in columns]).first()
    edges = [(c, float(row[c][0] or 0.0), (row[c][1] - row[c][0]) / bins if row[c][0] is not None and row[c][1] > row[c][0] else 1.0, float(row[c][1] if row[c][1] is not None else -1.0)) for c in columns]
    spans = reference.sparkSession.createDataFrame(edges, "feature string, low double, width double, high double")
    every = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counts = binned(reference, spans, bins)
    return every.join(counts, ["feature", "bin"], "left").select("feature", "low", "width", "high", "bin", F.coalesce("n", F.lit(0)).alias("a"))


def binned(rows: DataFrame, spans: DataFrame, bins: int, by: list[str] = ()) -> DataFrame:
    """by, feature, bin, n: counts of values within the spans of ``spans`` (feature, low, width, high), a row for each column; all columns in one scan."""
    names = [r["feature"] for r in spans.select("feature").distinct().collect()]
    values = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in names])))
    met = values.join(F.broadcast(spans.select("feature", "low", "width", "high").distinct()), "feature").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    cell = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / F.col("width"))).cast("int")
    return met.groupBy(*by, "feature", cell.alias("bin")).agg(F.count("*").alias("n"))


def numeric_monitor(bins_of: DataFrame, batches: DataFrame, batch: str, bins: int = 10, alert_at: float = 0.1, floor: float = 1e-4) -> DataFrame:
    """batch, feature, psi, severity, alert of numeric columns against ``reference_bins``, all batches in one pass. Values outside of the reference's range are left out."""
    q = binned(batches.withColumn("__batch", F.col(batch)), bins_of, bins, ["__batch"]).withColumnRenamed("__batch", "batch")
    return _judged(bins_of, q, alert_at, floor)


def _judged(bins_of: DataFrame, q: DataFrame, alert_at: float, floor: float) -> DataFrame:
    full = q.select("batch", "feature").distinct().join(F.broadcast(bins_of), "feature").join(q, ["batch", "feature", "bin"], "left").na.fill(0, ["n"])  # bins of a row for each column
    total = full.groupBy("batch", "feature").agg(F.sum("a").alias("na"), F.sum("n").alias("nb"))
    x, y = F.greatest(F.col("a") / F.greatest("na", F.lit(1)), F.lit(floor)), F.greatest(F.col("n") / F.greatest("nb", F.lit(1)), F.lit(floor))
    out = full.join(total, ["batch", "feature"]).groupBy("batch", "feature").agg(F.sum((y - x) * F.ln(y / x)).alias("psi"))
    return out.withColumns({"severity": severity(F.col("psi")), "alert": F.col("psi") >= alert_at})


class BatchMonitor:
    """``foreachBatch`` sink: a stream's counts in the reference's bins, batch by batch, in ``folder``.

    A batch's counts are a folder of their own, which a batch that runs again
    replaces, so replays count once. ``history`` has the drift of every batch,
    ``trend`` its course, ``recent`` that of the last batches taken together.
    """

    def __init__(self, folder: str, reference: DataFrame, columns: list[str], bins: int = 10):
        self.folder, self.bins, self.spark = folder.rstrip("/"), bins, reference.sparkSession
        reference_bins(reference, columns, bins).write.mode("overwrite").parquet(f"{self.folder}/reference")

    def reference(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/reference")

    def __call__(self, batch: DataFrame, number: int) -> None:
        binned(batch, self.reference(), self.bins).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counts/batch={number}")

    def counts(self) -> DataFrame:
        return self.spark.read.schema("feature string, bin int, n long, batch long").option("basePath", f"{self.folder}/counts").parquet(f"{self.folder}/counts")

    def history(self, alert_at: float = 0.1) -> DataFrame:
        return _judged(self.reference(), self.counts(), alert_at, 1e-4)

    def recent(self, batches: int, alert_at: float = 0.1) -> DataFrame:
        """The drift of the last batches as one, named by the last."""
        last = self.counts().agg(F.max("batch")).first()[0]
        own = self.counts().where(F.col("batch") > last - batches).groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.lit(last).alias("batch"))
        return _judged(self.reference(), own, alert_at, 1e-4)

    def trend(self) -> DataFrame:
        """feature, batches, slope of the drift over batches, direction."""
        g = self.history().groupBy("feature").agg(F.count("*").alias("batches"), F.regr_slope("psi", "batch").alias("slope"))
        return g.withColumn("direction", F.when(F.col("slope") > 0.01, "rising").when(F.col("slope") < -0.01, "falling").otherwise("stable"))


def severity(score):
    return F.when(score < 0.05, "none").when(score < 0.1, "low").when(score < 0.2, "medium").when(score < 0.5, "high").otherwise("critical")


def report(reference: DataFrame, current: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """feature, score, p_value, method, has_drift, severity of every column, one below the other."""
    parts = [numeric_drift(reference, current, c).select("feature", F.col("ks").alias("score"), "p_value", F.lit("ks").alias("method"), "has_drift") for c in numbers]
    parts += [categorical_drift(reference, current, c).select("feature", "score", "p_value", F.lit("chi2").alias("method"), "has_drift") for c in categories]
    return reduce(DataFrame.unionByName, parts).withColumn("severity", severity(F.col("score")))
