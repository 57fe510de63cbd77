"""Chunk reports that merge: counts, sums and extremes exactly, distinct values and quantiles by sketches.

A report is a row for each chunk and column. Reports of chunks, of runs and of
sites merge in any order into the report of their union, without the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketch: ranks are off by about 1.33 % of the rows at 200, by less the larger it is. 2 ** bits registers of the distinct sketch: off by 1.04 / sqrt of them.
RANKS, BITS = 400, 12
RANK_ERROR, DISTINCT_ERROR = 0.0075, 0.05


def chunk_sketches(df: DataFrame, columns: list[str], chunk: str = "chunk") -> DataFrame:
    """chunk, column, rows, missing, total, squares, least, greatest, distinct, ranks: a mergeable report of numeric columns.

    Rows are spread to a row for each column, sums and sketches are made in each
    task before the shuffle. Columns without values have null sketches.
    """
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    rows = df.select(F.col(chunk).alias("chunk"), values)
    return rows.groupBy("chunk", "column").agg(
        F.count("*").alias("rows"), F.count_if(F.col("v").isNull()).alias("missing"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"), F.min("v").alias("least"), F.max("v").alias("greatest"),
        F.hll_sketch_agg(F.col("v").cast("string"), BITS).alias("distinct"), F.kll_sketch_agg_double("v", RANKS).alias("ranks"),
    )


def merge_sketches(*reports: DataFrame, by: list[str] = ()) -> DataFrame:
    """Reports merged by column, and by the columns of ``by``: chunk keeps chunks apart."""
    every = reduce(DataFrame.unionByName, reports)
    return every.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"),
    )


def _quantile(p: float) -> Column:
    return F.when(F.col("rows") > F.col("missing"), F.kll_sketch_get_quantile_double("ranks", F.lit(p)))


def read_sketches(report: DataFrame, by: list[str] = ()) -> DataFrame:
    """column, rows, missing, mean, std (of the rows), least, greatest, exact; distinct, q1, median, q3, low, high (IQR fences), within the sketches' errors."""
    n = F.col("rows") - F.col("missing")
    mean = F.col("total") / F.when(n > 0, n)
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.when(n > 0, n) - mean * mean))
    q = report.select(*by, "column", "rows", "missing", mean.alias("mean"), std.alias("std"), "least", "greatest", F.hll_sketch_estimate("distinct").alias("distinct"), *[_quantile(p).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return q.withColumns({"low": F.col("q1") - spread, "high": F.col("q3") + spread})


def judged_chunks(report: DataFrame, whole: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """chunk, column, shift, drifted: by how much of the whole's spread a chunk's median lies off the whole's, from reports alone."""
    a = read_sketches(report, ["chunk"]).select("chunk", "column", F.col("median").alias("own"))
    b = read_sketches(whole).select("column", "median", (F.col("greatest") - F.col("least")).alias("range"))
    shift = F.abs(F.col("own") - F.col("median")) / F.when(F.col("range") > 0, F.col("range"))
    return a.join(F.broadcast(b), "column").select("chunk", "column", shift.alias("shift"), F.coalesce(shift > tolerance, F.lit(False)).alias("drifted"))  # a row for each column
