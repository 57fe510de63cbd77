"""Where issues gather: root causes by factor, time and number; weak slices of a model."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.pvalues import chi2_p, correlation_p, fisher_p, normal_p
from ..functions.quantiles import quantiles
from ..functions.working import written


def categorical_factors(df: DataFrame, factors: list[str], issue: str, least_rows: int = 30) -> DataFrame:
    """factor, value, rows, issues, rate, lift, chi2 (Yates) of every value of every factor with enough rows, in one aggregation."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("value")) for f in factors])).alias("x"), F.col(issue).cast("int").alias("y")).select("x.*", "y")
    counts = rows.where("value is not null").groupBy("factor", "value").agg(F.count("*").alias("rows"), F.sum("y").alias("issues"))
    whole = df.agg(F.count("*").alias("n"), F.sum(F.col(issue).cast("int")).alias("k"))
    a, r, n, k = (F.col(c).cast("double") for c in ("issues", "rows", "n", "k"))
    b, c = r - a, k - a
    d = n - r - c
    gap = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    chi2 = ratio(n * gap * gap, r * (n - r) * k * (n - k))
    base = ratio(k, n)
    return counts.crossJoin(F.broadcast(whole)).where(F.col("rows") >= least_rows).select("factor", "value", "rows", "issues", ratio(a, r).alias("rate"), ratio(ratio(a, r), base).alias("lift"), chi2.alias("chi2"))


def categorical_causes(df: DataFrame, factors: list[str], issue: str, least_lift: float = 1.5, alpha: float = 0.05) -> DataFrame:
    """Those factors' values with enough lift and significance, with p_value and strength."""
    found = categorical_factors(df, factors, issue).withColumn("p_value", chi2_p("chi2", F.lit(1.0)))
    strength = F.when(F.col("lift") >= 3, "very_strong").when(F.col("lift") >= 2, "strong").when(F.col("lift") >= 1.5, "moderate").otherwise("weak")
    return found.where((F.col("p_value") <= alpha) & (F.col("lift") >= least_lift)).withColumn("strength", strength)


def numeric_factors(df: DataFrame, columns: list[str], issue: str) -> DataFrame:
    """factor, correlation (point-biserial), p_value, n of every numeric column with the issue flag."""
    one = [F.struct(F.lit(c).alias("factor"), F.corr(F.col(c).cast("double"), F.col(issue).cast("double")).alias("correlation"), F.count(c).cast("double").alias("n")) for c in columns]
    return df.agg(F.array(*one).alias("all")).select(F.inline("all")).withColumn("p_value", correlation_p("correlation", "n"))


def quartile_rates(df: DataFrame, column: str, issue: str) -> DataFrame:
    """quartile, rows, rate: issue rates between a column's quartiles."""
    q1, q2, q3 = quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    c = F.col(column)
    part = F.when(c <= q1, 1).when(c <= q2, 2).when(c <= q3, 3).otherwise(4)
    return df.where(c.isNotNull()).groupBy(part.alias("quartile")).agg(F.count("*").alias("rows"), F.avg(F.col(issue).cast("int")).alias("rate"))


def daily_rates(df: DataFrame, ts: str, issue: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("rows"), F.sum(F.col(issue).cast("int")).alias("issues"), F.avg(F.col(issue).cast("int")).alias("rate"))


def calendar_rates(df: DataFrame, ts: str, issue: str, unit: str) -> DataFrame:
    """unit, rows, rate by ISO week or by day of the week (Monday 0)."""
    part = F.weekofyear(ts) if unit == "week" else F.weekday(ts)
    return df.groupBy(part.alias(unit)).agg(F.count("*").alias("rows"), F.avg(F.col(issue).cast("int")).alias("rate"))


def spikes(df: DataFrame, ts: str, issue: str, sigmas: float = 2.0, least_days: int = 7) -> DataFrame:
    """day, rate of days over the mean daily rate by that many population deviations."""
    daily = daily_rates(df, ts, issue)
    s = daily.agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("std"), F.count("*").alias("days"))
    return daily.crossJoin(F.broadcast(s)).where((F.col("days") >= least_days) & (F.col("rate") > F.col("mean") + sigmas * F.col("std"))).select("day", "rate")


def time_trend(df: DataFrame, ts: str, issue: str) -> DataFrame:
    """slope, r2 of daily rates over the days in order; at most a row a day is ordered."""
    daily = daily_rates(df, ts, issue)
    ranked = daily.withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    return ranked.agg(F.regr_slope("rate", "i").alias("slope"), F.regr_r2("rate", "i").alias("r2"))


def conditions(df: DataFrame, numbers: list[str], categories: list[str], bins: int = 5) -> DataFrame:
    """The table with an array column ``conditions``: of each row, the interval of every number and the value of every category."""
    q = quantiles(df, numbers, [i / bins for i in range(1, bins)]) if numbers else {}
    parts = []
    for c in numbers:
        cuts = sorted(set(x for x in q[c] if x is not None))
        at = F.lit(0)
        for i, cut in enumerate(cuts):
            at = F.when(F.col(c) > cut, i + 1).otherwise(at)
        parts.append(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:q"), at.cast("string"))))
    parts += [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in categories]
    return df.withColumn("conditions", F.array_compact(F.array(*parts)))


def combined(df: DataFrame, correct: str, numbers: list[str], categories: list[str]) -> DataFrame:
    """conditions, rows, ok: how many rows have the same conditions in all features; all slices are sums of these."""
    return conditions(df, numbers, categories).groupBy("conditions").agg(F.count("*").alias("rows"), F.sum(F.col(correct).cast("int")).alias("ok"))


def slices(df: DataFrame, correct: str, numbers: list[str], categories: list[str], depth: int = 1, least_rows: int = 50, least_share: float = 0.01, marked: DataFrame | None = None) -> DataFrame:
    """slice, rows, accuracy, gap: every condition, and up to ``depth`` of different features together, with enough rows.

    gap is the accuracy of the whole table less the slice's. Rows of the same
    conditions are counted first, with map-side sums, and slices made of those
    counts, ``combined``'s, which may be given as ``marked``.
    """
    marked = combined(df, correct, numbers, categories) if marked is None else marked
    width = len(numbers) + len(categories)
    sets = [c for d in range(1, depth + 1) for c in combinations(range(width), d)]
    own = F.array(*[F.when(F.size("conditions") > max(c), F.concat_ws(" & ", *[F.col("conditions")[i] for i in c])) for c in sets])
    rows = marked.select(F.explode(F.array_compact(own)).alias("slice"), "rows", "ok")
    whole = df.agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("int")).alias("base"))
    g = rows.groupBy("slice").agg(F.sum("rows").alias("rows"), F.sum("ok").alias("ok")).crossJoin(F.broadcast(whole))
    g = g.where((F.col("rows") >= least_rows) & (F.col("rows") >= least_share * F.col("n")))
    return g.select("slice", "rows", (F.col("ok") / F.col("rows")).alias("accuracy"), (F.col("base") - F.col("ok") / F.col("rows")).alias("gap"), (F.col("rows") - F.col("ok")).alias("errors"), "n", "base")


def weak_slices(df: DataFrame, correct: str, numbers: list[str], categories: list[str], depth: int = 1, least_gap: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """slice, rows, accuracy, gap, p_value of slices significantly worse than the rest (Fisher's exact test)."""
    s = slices(df, correct, numbers, categories, depth).where(F.col("gap") >= least_gap)
    errors = (F.col("n") * (1 - F.col("base"))).cast("long")
    s = s.withColumn("p_value", fisher_p("errors", F.col("rows") - F.col("errors"), errors - F.col("errors"), F.col("n") - F.col("rows") - errors + F.col("errors")))
    return s.where(F.col("p_value") <= alpha).select("slice", "rows", "accuracy", "gap", "p_value")


def slice_overlaps(df: DataFrame, numbers: list[str], categories: list[str], depth: int, found: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """a, b, shared: rows that lie in both of two of the slices ``found``, for a = b a slice's size.

    Rows of the same conditions are counted first, which may be given as
    ``marked``; pairs are made of those of their slices that were found.
    """
    names = F.lit([r["slice"] for r in found.select("slice").collect()])  # the slices to be pruned, a chosen number
    marked = conditions(df, numbers, categories).groupBy("conditions").agg(F.count("*").alias("rows")) if marked is None else marked
    sets = [c for d in range(1, depth + 1) for c in combinations(range(len(numbers) + len(categories)), d)]
    own = F.array_compact(F.array(*[F.when(F.size("conditions") > max(c), F.concat_ws(" & ", *[F.col("conditions")[i] for i in c])) for c in sets]))
    rows = marked.select(F.array_sort(F.array_intersect(own, names)).alias("s"), "rows")
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 1, F.size("s") - i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.select(F.inline(pairs), "rows").groupBy("a", "b").agg(F.sum("rows").alias("shared"))


def pruned_slices(df: DataFrame, correct: str, numbers: list[str], categories: list[str], depth: int = 2, most: int = 200, least_gap: float = 0.05, overlap: float = 0.9, near: float = 0.02) -> DataFrame:
    """slice, rows, accuracy, gap of the ``most`` worst slices, less those of which a kept, worse one covers over ``overlap`` at about the same gap.

    Greedy over slices, worst first, ties by name; the driver sees a row for
    each slice and for each pair that overlaps.
    """
    marked = written(combined(df, correct, numbers, categories))
    s = slices(df, correct, numbers, categories, depth, marked=marked).where(F.col("gap") >= least_gap).select("slice", "rows", "accuracy", "gap")
    found = s.orderBy(F.desc(F.round("gap", 12)), "slice").limit(most)
    rows = found.collect()
    shared = {}
    for r in slice_overlaps(df, numbers, categories, depth, df.sparkSession.createDataFrame(rows, found.schema), marked).where("a <> b").collect() if rows else []:
        shared[r["a"], r["b"]] = shared[r["b"], r["a"]] = r["shared"]
    kept = []
    for r in rows:
        if not any(shared.get((r["slice"], k["slice"]), 0) > overlap * r["rows"] and abs(k["gap"] - r["gap"]) <= near for k in kept):
            kept.append(r)
    return df.sparkSession.createDataFrame(kept, found.schema)


def performance_drop(runs: DataFrame, order: str, metric: str, window: int = 5) -> DataFrame:
    """order, value, baseline, drop, z, p_value of every run against the window before it."""
    w = Window.orderBy(order).rowsBetween(-window, -1)  # a table of runs is small
    rows = runs.select(order, F.col(metric).alias("value"), F.avg(metric).over(w).alias("baseline"), F.stddev_pop(metric).over(w).alias("std"))
    rows = rows.where("baseline is not null").withColumns({"drop": ratio(F.col("baseline") - F.col("value"), F.col("baseline")), "z": ratio(F.col("value") - F.col("baseline"), F.col("std"))})
    return rows.withColumn("p_value", normal_p("z"))
