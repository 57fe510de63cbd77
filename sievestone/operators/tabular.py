"""Columns of a table: missing values, codes, scales, profiles, predicates, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import numeric_columns, ratio
from ..functions.quantiles import grouped_quantiles, quantiles
from ..functions.ranges import carried


def predicate(df: DataFrame, feature: str, operator: str, value) -> Column:
    """A slice's test as a column, never null; an unknown feature or operator fits no row. ``between`` includes both ends."""
    if feature not in df.columns:
        return F.lit(False)
    c = F.col(f"`{feature}`")
    tests = {"==": lambda: c == value, "!=": lambda: c != value, "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value, "in": lambda: c.isin(*value), "between": lambda: c.between(*value)}
    return F.coalesce(tests[operator](), F.lit(False)) if operator in tests else F.lit(False)


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns or df.columns)


def most_frequent(df: DataFrame, column: str):
    """The most frequent value, the smallest of several; None without values."""
    row = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).first()
    return row[0] if row else None


def fill_missing(df: DataFrame, columns: list[str], strategy: str = "mean", value=None) -> DataFrame:
    """Nulls replaced by a constant (``fill``) or each column's mean, median or mode."""
    if strategy == "fill":
        fills = dict.fromkeys(columns, value)
    elif strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        fills = {c: row[c] for c in columns}
    elif strategy == "median":
        fills = {c: q[0] for c, q in quantiles(df, columns, [0.5]).items()}
    elif strategy == "mode":
        fills = {c: most_frequent(df, c) for c in columns}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return df.select(*[F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if fills.get(c) is not None else F.col(c) for c in df.columns])


def carry(df: DataFrame, column: str, order: str, partition: list[str], backward: bool = False) -> DataFrame:
    """Nulls replaced by the last value before, or the next one after, within partitions; ranges of the order go to tasks of their own."""
    return carried(df, partition, order, column, backward)


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """label, code: distinct labels from 0 in sorted order. Codes are few; rows are joined to them, not sorted."""
    return df.select(label).where(F.col(label).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)


def encode(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """The table with each label's code; null labels have none."""
    return df.join(label_codes(df, label).withColumnRenamed("code", out), label, "left")


def decode(df: DataFrame, codes: DataFrame, code: str, label: str) -> DataFrame:
    """The table with the label of each code of ``label_codes``; unknown and null codes have none."""
    return df.join(codes.select(F.col("code").alias(code), label), code, "left")


def scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; columns without spread become 0."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    scaled = {c: (F.col(c) - row[f"m{i}"]) / row[f"s{i}"] if row[f"s{i}"] else F.lit(0.0) for i, c in enumerate(columns)}
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row a column: column, rows, missing, distinct, mean, std (sample), least and greatest (as text), in one pass."""
    columns = columns or df.columns
    numbers = set(numeric_columns(df))
    one = []
    for c in columns:
        number = F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")
        one.append(F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_distinct(c).alias("distinct"),
            F.avg(number).alias("mean"), F.stddev_samp(number).alias("std"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest"),
        ))
    return df.agg(F.array(*one).alias("all")).select(F.inline("all"))


def feature_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Completeness, uniqueness, consistency (1 - share beyond the IQR fences), validity and their weighted mean, a row a column."""
    numbers = [c for c in columns if c in numeric_columns(df)]
    q = quantiles(df, numbers, [0.25, 0.75]) if numbers else {}
    one = []
    for c in columns:
        n, own = F.count("*"), F.col(c)
        complete = ratio(F.count(own), n)
        if c in q and q[c][0] is not None:
            low, high = q[c][0] - 1.5 * (q[c][1] - q[c][0]), q[c][1] + 1.5 * (q[c][1] - q[c][0])
            unique, consistent = F.lit(1.0), 1 - ratio(F.count_if((own < low) | (own > high)), F.count(own))
        else:
            unique, consistent = ratio(F.count_distinct(own), n), F.lit(1.0)
        one.append(F.struct(F.lit(c).alias("column"), complete.alias("completeness"), unique.alias("uniqueness"), consistent.alias("consistency"), F.lit(1.0).alias("validity")))
    rows = df.agg(F.array(*one).alias("all")).select(F.inline("all"))
    return rows.withColumn("overall", F.expr("0.3 * completeness + 0.2 * uniqueness + 0.25 * consistency + 0.25 * validity"))


def missing_rate(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    return df.agg((reduce(Column.__add__, [F.avg(F.col(c).isNull().cast("int")) for c in columns]) / len(columns)).alias("missing_rate"))


def k_anonymity(df: DataFrame, columns: list[str]) -> DataFrame:
    """The least number of rows that share their values in all columns; rows with a null are left out."""
    return df.na.drop(subset=columns).groupBy(*columns).count().agg(F.min("count").alias("k"))


def l_diversity(df: DataFrame, columns: list[str]) -> DataFrame:
    """The mean over columns of distinct values to rows."""
    return df.agg((reduce(Column.__add__, [F.count_distinct(c) / F.count("*") for c in columns]) / len(columns)).alias("l"))


def meta_features(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """One row about a table: sizes, missing and duplicate rates, mean skew and kurtosis sizes, label entropy and imbalance."""
    c = len(columns)
    mean = lambda parts: reduce(Column.__add__, parts) / c
    main = df.agg(
        F.count("*").alias("n_samples"), F.lit(c).alias("n_features"), mean([F.avg(F.col(x).isNull().cast("int")) for x in columns]).alias("missing_rate"),
        mean([F.abs(F.skewness(x)) for x in columns]).alias("mean_skew"), mean([F.abs(F.kurtosis(x)) for x in columns]).alias("mean_kurtosis"),
    )
    shares = df.groupBy(label).agg(F.count("*").alias("n"))
    labels = shares.crossJoin(shares.agg(F.sum("n").alias("total"))).agg(F.sum(-(F.col("n") / F.col("total")) * F.log2(F.col("n") / F.col("total") + 1e-10)).alias("label_entropy"), (F.max("n") / F.min("n")).alias("imbalance_ratio"), F.count("*").alias("n_classes"))
    copies = df.groupBy(*columns).count().agg((1 - F.count("*") / F.sum("count")).alias("duplicate_rate"))
    return main.crossJoin(labels).crossJoin(copies)


def chunked(df: DataFrame, key: str, size: int) -> DataFrame:
    """A chunk number by rank of a dense integer key: key div size. Chunks don't need a sort of the whole table."""
    return df.withColumn("chunk", F.floor(F.col(key) / size).cast("long"))


def chunk_report(df: DataFrame, columns: list[str], chunk: str = "chunk") -> DataFrame:
    """Per chunk: rows, rows beyond the chunk's own IQR fences in any column, repeated rows, score. Fences come from ranks, so a chunk may have any size."""
    q = grouped_quantiles(df, chunk, columns, [0.25, 0.75])
    fences = q.select(chunk, *[F.col(c).alias(f"q_{c}") for c in columns])
    joined = df.join(fences, chunk)
    out = F.lit(False)
    for c in columns:
        q1, q3 = F.col(f"q_{c}")[0], F.col(f"q_{c}")[1]
        out = out | F.coalesce((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1)), F.lit(False))
    outliers = joined.groupBy(chunk).agg(F.count("*").alias("rows"), F.count_if(out).alias("outliers"))
    copies = df.groupBy(chunk, *columns).count().groupBy(chunk).agg(F.sum(F.col("count") - 1).alias("duplicates"))
    score = F.greatest(F.lit(0.0), 100 - 100 * (F.col("outliers") + F.col("duplicates")) / F.col("rows"))
    return outliers.join(copies, chunk).withColumn("score", score)


def set_operations(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    return {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
