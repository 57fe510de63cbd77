"""Synthetic tables: checks against real ones, generators, augmentation, planted issues."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, zero_filled
from ..functions.ranges import fresh, ranked
from .drift import cumulative


def mode_collapse(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """feature, std_ratio, unique_ratio, collapsed: synthetic spread under a tenth, or distinct values under half, of the real."""
    one = lambda df, tag: df.agg(*[F.struct(F.stddev_samp(c).alias("s"), F.count_distinct(c).alias("u")).alias(f"{tag}{i}") for i, c in enumerate(columns)])
    both = one(real, "r").crossJoin(one(synth, "s"))
    rows = [F.struct(F.lit(c).alias("feature"), ratio(F.col(f"s{i}.s"), F.col(f"r{i}.s"), 1.0).alias("std_ratio"), ratio(F.col(f"s{i}.u"), F.col(f"r{i}.u"), 1.0).alias("unique_ratio")) for i, c in enumerate(columns)]
    return both.select(F.inline(F.array(*rows))).withColumn("collapsed", F.expr("std_ratio < 0.1 or unique_ratio < 0.5"))


def distribution_gaps(real: DataFrame, synth: DataFrame, numbers: list[str], categories: list[str] = ()) -> DataFrame:
    """feature, gap (KS or total variation), fidelity = 100 - 100 gap."""
    parts = [cumulative(real, synth, c).agg(F.lit(c).alias("feature"), F.max(F.abs(F.col("f") - F.col("g"))).alias("gap")) for c in numbers]
    for c in categories:
        from .drift import category_counts

        counts = category_counts(real, synth, c)
        total = counts.agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
        parts.append(counts.crossJoin(F.broadcast(total)).agg(F.lit(c).alias("feature"), (F.sum(F.abs(F.col("a") / F.col("n") - F.col("b") / F.col("m"))) / 2).alias("gap")))
    return reduce(DataFrame.unionByName, parts).withColumn("fidelity", 100 - 100 * F.col("gap"))


def correlation_gaps(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, real, synthetic, gap of every pair of columns."""
    pairs = list(combinations(columns, 2))
    one = lambda df, tag: df.agg(*[F.corr(a, b).alias(f"{tag}{i}") for i, (a, b) in enumerate(pairs)])
    both = one(real, "r").crossJoin(one(synth, "s"))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("real"), F.col(f"s{i}").alias("synthetic"), F.abs(F.col(f"r{i}") - F.col(f"s{i}")).alias("gap")) for i, (a, b) in enumerate(pairs)]
    return both.select(F.inline(F.array(*rows)))


def standardised(df: DataFrame, key: str, columns: list[str], base: DataFrame) -> DataFrame:
    """key, v: rows as vectors of z-scores by the base table's mean and deviation."""
    row = base.agg(*[F.struct(F.avg(zero_filled(c)), F.stddev_samp(zero_filled(c))).alias(c) for c in columns]).first()
    parts = [(zero_filled(c) - (row[c][0] or 0.0)) / (row[c][1] or 1.0) for c in columns]
    return df.select(F.col(key).cast("long").alias("key"), F.array(*parts).alias("v"))


def nearest_distances(rows: DataFrame, others: DataFrame, key: str, columns: list[str], base: DataFrame) -> DataFrame:
    """query, distance of every row to the nearest of the others in z-scores; negative keys keep the tables apart."""
    from .vectors import closest

    a = standardised(rows, key, columns, base).select((-F.col("key") - 1).alias("key"), "v")
    b = standardised(others, key, columns, base)
    return closest(a, b, "key", "v").select((-F.col("query") - 1).alias("query"), "distance")


def memorisation(real: DataFrame, synth: DataFrame, key: str, columns: list[str], near: float = 0.1) -> DataFrame:
    """One row: rows, copied (nearest real row under ``near``), rate, privacy = max(0, 100 - 200 rate)."""
    d = nearest_distances(synth, real, key, columns, real)
    return d.agg(F.count("*").alias("rows"), F.count_if(F.col("distance") < near).alias("copied")).select("rows", "copied", ratio(F.col("copied"), F.col("rows")).alias("rate"), F.greatest(F.lit(0.0), 100 - 200 * ratio(F.col("copied"), F.col("rows"))).alias("privacy"))


def diversity(synth: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """min(100, 50 times the mean distance to the nearest other row)."""
    from .vectors import closest

    v = standardised(synth, key, columns, synth)
    return closest(v, v, "key", "v").agg(F.least(F.lit(100.0), 50 * F.avg("distance")).alias("diversity"))


def certificate(scores: DataFrame) -> DataFrame:
    """Of one row (fidelity, privacy, utility, diversity, coherence): overall, status, failed checks."""
    # Limits and weights.
    least = {"fidelity": 70.0, "privacy": 80.0, "utility": 70.0, "diversity": 60.0, "coherence": 70.0}
    failed = F.array_compact(F.array(*[F.when(F.col(k) < v, F.lit(k)) for k, v in least.items()]))
    overall = F.expr("0.25 * fidelity + 0.30 * privacy + 0.25 * utility + 0.10 * diversity + 0.10 * coherence")
    return scores.select(overall.alias("overall"), F.array_join(F.array_sort(failed), ",").alias("failed"), F.when(F.size(failed) == 0, "certified").when(F.size(failed) <= 1, "conditional").otherwise("rejected").alias("status"))


def gaussian_copula(real: DataFrame, columns: list[str], rows: int, seed: int = 42) -> DataFrame:
    """Rows drawn from a normal law with the real table's means, deviations and correlations; only their moments reach the driver."""
    pairs = list(combinations(range(len(columns)), 2))
    row = real.agg(*[F.avg(c) for c in columns], *[F.stddev_samp(c) for c in columns], *[F.corr(columns[i], columns[j]) for i, j in pairs]).first()
    k = len(columns)
    c = np.eye(k)
    for (i, j), r in zip(pairs, row[2 * k :], strict=True):
        c[i, j] = c[j, i] = 0.0 if r is None or r != r else r
    values, vectors = np.linalg.eigh(c)
    low = np.linalg.cholesky(vectors @ np.diag(np.maximum(values, 1e-9)) @ vectors.T)
    draws = real.sparkSession.range(rows).select("id", *[F.randn(seed + i).alias(f"z{i}") for i in range(k)])
    mixed = [row[i] + (row[k + i] or 0.0) * sum((float(low[i, j]) * F.col(f"z{j}") for j in range(i + 1)), F.lit(0.0)) for i in range(k)]
    return draws.select(F.col("id").alias("key"), *[m.alias(c) for m, c in zip(mixed, columns, strict=True)])


def augmentation_plan(df: DataFrame, label: str, ratio_over: float = 2.0, least: int = 10, most: float = 5.0) -> DataFrame:
    """label, count, target, multiplier, operation for classes that the largest outnumbers by more than ``ratio_over``."""
    from .labels import class_distribution

    d = class_distribution(df, label)
    top = d.agg(F.max("count").alias("most"))
    target = F.greatest(F.least((F.col("most") / ratio_over).cast("long"), (F.col("count") * most).cast("long")), F.lit(least).cast("long"))
    plan = d.crossJoin(F.broadcast(top)).where(F.col("most") / F.col("count") > ratio_over).select("label", "count", target.alias("target"))
    m = F.col("target") / F.col("count")
    return plan.select("label", "count", "target", m.alias("multiplier"), F.when(m <= 2, "oversample").when(m <= 3, "noise").otherwise("smote").alias("operation"))


def oversample(df: DataFrame, label: str, key: str, plan: DataFrame) -> DataFrame:
    """The table and copies of rows of planned classes, up to their targets, the same rows on every run.

    Rows of a class are taken in the order of their key's hash, ranked over
    ranges of it, so that no task holds a class.
    """
    mark, place, copy = fresh(df, "mark", "place", "copy")
    plan = plan.select(F.col("label").alias("planned"), F.col("target").alias("planned_target"), F.col("count").alias("planned_count"))
    small = df.join(F.broadcast(plan), df[label] == plan["planned"]).withColumn(mark, F.xxhash64(key))
    rows = ranked(small, [label], mark, place, ties=key)
    many = F.sequence(F.lit(1), F.greatest(F.ceil(F.col("planned_target") / F.col("planned_count")).cast("int"), F.lit(1)))
    extra = rows.withColumn(copy, F.explode(many)).where(F.col(place) - 1 + F.col(copy) * F.col("planned_count") < F.col("planned_target"))
    return df.unionByName(extra.select(*df.columns))


def noisy(df: DataFrame, columns: list[str], level: float = 0.05, seed: int = 42) -> DataFrame:
    """Numbers with normal noise of ``level`` of each column's deviation."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.col(c) + F.randn(seed + i) * (level * (row[c] or 0.0)) for i, c in enumerate(columns)})


def interpolated(df: DataFrame, key: str, label: str, columns: list[str], plan: DataFrame, low: float = 0.2, high: float = 0.8, seed: int = 42) -> DataFrame:
    """source, partner, label and ``columns``: points between two rows of a planned class, as many as its target lacks, the same on every run.

    A class's rows are ranked by their key's hash over ranges of it; a row's
    partner for its j-th point is the row j places on, round about, so partners
    are found by a join on ranks. The share of the partner lies between ``low``
    and ``high``. A class of one row has no points; null numbers stay null.
    """
    mark, place = fresh(df, "mark", "place")
    plan = plan.select(F.col("label").alias("planned"), (F.col("target") - F.col("count")).alias("lacking"), F.col("count").alias("own_rows")).where("lacking > 0 and own_rows > 1")
    small = df.select(key, label, *columns).join(F.broadcast(plan), df[label] == plan["planned"]).withColumn(mark, F.xxhash64(key, F.lit(seed)))  # a row for each class
    rows = ranked(small, [label], mark, place, ties=key)
    rounds = F.sequence(F.lit(1).cast("long"), F.greatest(F.ceil(F.col("lacking") / F.col("own_rows")).cast("long"), F.lit(1).cast("long")))
    wanted = rows.withColumn("round", F.explode(rounds)).where((F.col("round") - 1) * F.col("own_rows") + F.col(place) <= F.col("lacking"))
    step = F.pmod(F.col("round") - 1, F.col("own_rows") - 1) + 1
    wanted = wanted.withColumn("other", F.pmod(F.col(place) - 1 + step, F.col("own_rows")) + 1)
    a, b = wanted.alias("a"), rows.alias("b")
    met = a.join(b, (F.col(f"a.{label}") == F.col(f"b.{label}")) & (F.col("a.other") == F.col(f"b.{place}")))
    share = low + (high - low) * F.pmod(F.xxhash64(F.col(f"a.{key}"), F.col("a.round"), F.lit(seed + 1)), F.lit(1000)) / 1000
    return met.select(F.col(f"a.{key}").alias("source"), F.col(f"b.{key}").alias("partner"), F.col(f"a.{label}").alias(label), *[(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * share).alias(c) for c in columns])


def drawn_categories(real: DataFrame, column: str, draws: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``draws`` with a category for each row, drawn by the real table's frequencies, nulls among them.

    A row's hash falls into one of the running shares of the categories; rows and
    shares meet by buckets of the hash, so a table of many categories may be of
    any size.
    """
    size = 1 << 40
    counts = real.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    w = Window.orderBy(F.desc("n"), F.col("value").asc_nulls_last())
    runs = counts.crossJoin(F.broadcast(total)).withColumn("until", (F.sum("n").over(w) / F.col("t") * size).cast("long"))  # a row for each category
    runs = runs.select("value", F.lag("until", 1, 0).over(w).alias("since"), "until").where("until > since")
    marked = draws.withColumn("at", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(size)))
    buckets = 1024
    spread = runs.withColumn("bucket", F.explode(F.sequence(F.expr(f"since div {size // buckets}"), F.expr(f"(until - 1) div {size // buckets}"))))
    met = marked.withColumn("bucket", F.expr(f"at div {size // buckets}")).join(spread, ["bucket"]).where("at >= since and at < until")
    return met.select(*draws.columns, F.col("value").alias(column))


def smote(vectors: DataFrame, key: str, vector: str, k: int = 5, seed: int = 42) -> DataFrame:
    """key, v: a point between every row and one of its k nearest, both picked by hash."""
    from .vectors import top_k

    near = top_k(vectors, vectors, key, vector, k, "euclidean")
    pick = near.where(F.col("rank") == F.pmod(F.xxhash64("query", F.lit(seed)), F.lit(k)) + 1)
    a = vectors.select(F.col(key).cast("long").alias("query"), F.col(vector).alias("a"))
    b = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("b"))
    share = F.pmod(F.xxhash64("query", F.lit(seed + 1)), F.lit(1000)) / 1000
    return pick.join(a, "query").join(b, "key").select(F.col("query").alias("key"), F.zip_with("a", "b", lambda x, y: x + (y - x) * share).alias("v"))


def plant_label_noise(df: DataFrame, key: str, label: str, classes: int, share: float = 0.1, seed: int = 42) -> DataFrame:
    """The table with labels moved to the next class in a share of rows, by hash, and ``is_planted``."""
    hit = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return df.withColumn("is_planted", hit).withColumn(label, F.when(hit, F.pmod(F.col(label) + 1, F.lit(classes))).otherwise(F.col(label)))


def plant_outliers(df: DataFrame, key: str, columns: list[str], share: float = 0.05, sigmas: float = 10.0, seed: int = 42) -> DataFrame:
    row = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    hit = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return df.withColumn("is_planted", hit).withColumns({c: F.when(hit, F.col(c) + sigmas * (row[c] or 0.0)).otherwise(F.col(c)) for c in columns})
