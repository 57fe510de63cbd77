"""Checks of inputs, per-chunk label counts and merged reports, class gaps, key names, seeded samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(df: DataFrame, features: list[str], label: str | None = None, least_rows: int = 1, least_features: int = 1, least_classes: int = 2) -> DataFrame:
    """check, value, least, passed: rows, features and, with a label, labelled rows and classes, in one pass. Null labels are no class."""
    checks = [("rows", F.count("*"), least_rows), ("features", F.lit(len(features)).cast("long"), least_features)]
    if label:
        checks += [("labels", F.count(label), 1), ("classes", F.count_distinct(label), least_classes)]
    one = [F.struct(F.lit(name).alias("check"), value.alias("value"), F.lit(least).cast("long").alias("least"), (value >= least).alias("passed")) for name, value, least in checks]
    return df.agg(F.array(*one).alias("all")).select(F.inline("all"))


def require(df: DataFrame, features: list[str], label: str | None = None, **least: int) -> DataFrame:
    """The table itself, if it passes ``validate``; else a ValueError that names what is short."""
    failed = [f"{r['check']}: {r['value']}, at least {r['least']} needed" for r in validate(df, features, label, **least).where("not passed").collect()]
    if failed:
        raise ValueError("; ".join(failed))
    return df


def chunk_labels(df: DataFrame, label: str, chunk: str = "chunk") -> DataFrame:
    """chunk, label, count, ratio: each chunk's labels; null labels are one more."""
    counts = df.groupBy(chunk, F.col(label).alias("label")).agg(F.count("*").alias("count"))
    whole = df.groupBy(F.col(chunk).alias("whole_chunk")).agg(F.count("*").alias("whole"))
    joined = counts.join(whole, counts[chunk].eqNullSafe(whole["whole_chunk"]))
    return joined.select(chunk, "label", "count", (F.col("count") / F.col("whole")).alias("ratio"))


def merged(reports: DataFrame, totals: list[str], score: str = "score", rows: str = "rows") -> DataFrame:
    """One row of a table of chunk reports: chunks, rows, sums of ``totals``, the score weighted by rows and its plain mean."""
    weighted = F.sum(F.col(score) * F.col(rows)) / F.sum(rows)
    return reports.agg(F.count("*").alias("chunks"), F.sum(rows).alias(rows), *[F.sum(c).alias(c) for c in totals], weighted.alias("weighted_score"), F.avg(score).alias("mean_score"))


def class_gaps(df: DataFrame, label: str, features: list[str] = (), balance: float = 2.0, most: float = 5.0) -> DataFrame:
    """gap, label, rows, target, severity of classes to augment, gravest first.

    ``imbalance``: the largest class is over ``balance`` times as large; the
    target is the largest over ``balance``, at most ``most`` times the class.
    ``low_diversity``: of a class of ten rows or more, over 30 % of the features
    have a variance under 0.01; the target is half as much again.
    """
    flat = reduce(Column.__add__, [(F.coalesce(F.var_pop(F.col(c).cast("double")), F.lit(0.0)) < 0.01).cast("int") for c in features], F.lit(0))
    g = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"), flat.alias("flat"))
    g = g.crossJoin(F.broadcast(g.agg(F.max("rows").alias("largest"))))
    ratio = F.col("largest") / F.col("rows")
    target = F.least(F.floor(F.col("largest") / balance), F.floor(F.col("rows") * most))
    one = g.where(ratio > balance).select(F.lit("imbalance").alias("gap"), "label", "rows", target.alias("target"), F.least(ratio / 10, F.lit(1.0)).alias("severity"))
    two = g.where((F.col("rows") >= 10) & (F.col("flat") > 0.3 * len(features))).select(F.lit("low_diversity").alias("gap"), "label", "rows", F.floor(F.col("rows") * 1.5).alias("target"), F.lit(0.4).alias("severity"))
    return one.unionByName(two).orderBy(F.desc("severity"), "gap", "label")


def plausible(rows: DataFrame, original: DataFrame, label: str, features: list[str], sigmas: float = 3.0) -> DataFrame:
    """Augmented rows whose features all lie within ``sigmas`` deviations of their class's mean in the original table; unknown classes go."""
    stats = original.groupBy(F.col(label).alias("own_label")).agg(*[f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = rows.join(stats, rows[label] == stats["own_label"])
    fits = reduce(Column.__and__, [F.coalesce(F.abs(F.col(c) - F.col(f"m_{i}")) <= sigmas * F.col(f"s_{i}") + 1e-12, F.lit(True)) for i, c in enumerate(features)], F.lit(True))
    return joined.where(fits).select(*[rows[c] for c in rows.columns])


def key_names(df: DataFrame) -> list[tuple[str, str]]:
    """Pairs of columns, x_id (or xId) and x_name, of which the first probably refers to what the second names."""
    names = {c.lower(): c for c in df.columns}
    ids = [c for c in df.columns if "_id" in c.lower() or c.endswith("Id")]
    return [(c, names[other]) for c in ids if (other := c.replace("_id", "").replace("Id", "").lower() + "_name") in names]


def sample_rows(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """``most`` rows by the order of their key's hash, the same on every run; all of a smaller table. A sampling operator: its limit is its purpose."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)
