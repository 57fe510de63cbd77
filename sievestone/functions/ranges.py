"""Ranks and running sums over ordered rows of any number: ranges of the order, each in its own task, and totals carried between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range should have, and the most ranges that are made.
RANGE_ROWS, MOST_RANGES = 500_000, 4096


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until the table has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
        taken.add(name)
    return out


def in_ranges(df: DataFrame, order: str, out: str) -> DataFrame:
    """The table with a range number that rises with a column's value; equal values share a range, nulls are in the first."""
    parts = min(MOST_RANGES, max(1, -(-df.count() // RANGE_ROWS)))
    cuts = []
    if parts > 1:
        cuts = sorted(set(df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []))
    if not cuts:
        return df.withColumn(out, F.lit(0))
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(order) > c))
    return df.withColumn(out, F.when(F.col(order).isNull(), 0).otherwise(above))


def ranked(df: DataFrame, partition: list[str], order: str, rank: str, sums: dict[str, Column] | None = None, ties: str | None = None) -> DataFrame:
    """The table with each row's rank from 1 in its partition by ``order``, then ``ties``, and running sums of columns up to it.

    Rows of one partition and range are numbered in one task; the counts and
    sums of the ranges before are a row for each partition and range.
    """
    sums = sums or {}
    (part,) = fresh(df, "range")
    placed = in_ranges(df, order, part)
    w = Window.partitionBy(*partition, part).orderBy(order, *([ties] if ties else []))
    total = placed.groupBy(*partition, part).agg(F.count("*").alias("n_before"), *[F.sum(c).alias(f"{k}_before") for k, c in sums.items()])
    before = Window.partitionBy(*partition).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = ["n_before", *[f"{k}_before" for k in sums]]
    total = total.select(*[F.col(c).alias(f"{c}_key") for c in [*partition, part]], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names])
    own = placed.select("*", F.row_number().over(w).alias(rank), *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k, c in sums.items()])
    same = reduce(Column.__and__, [own[c].eqNullSafe(total[f"{c}_key"]) for c in [*partition, part]])
    joined = own.join(total, same)
    added = {rank: F.col(rank) + F.col("n_before"), **{k: F.coalesce(F.col(k), F.lit(0)) + F.col(f"{k}_before") for k in sums}}
    return joined.select(*[own[c] for c in df.columns], *[c.alias(k) for k, c in added.items()])


def carried(df: DataFrame, partition: list[str], order: str, column: str, backward: bool = False) -> DataFrame:
    """The table with a column's nulls replaced by the last value before in its partition, or the next one after."""
    part, found = fresh(df, "range", "found")
    placed = in_ranges(df, order, part)
    # what comes next is the last of what came before in the other order: a frame that ends at the row grows by one row at a time, one that starts there is read anew for every row
    w = Window.partitionBy(*partition, part).orderBy(F.desc(order) if backward else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    within = F.last(column, ignorenulls=True).over(w)
    edge = (F.min_by if backward else F.max_by)(column, F.when(F.col(column).isNotNull(), F.col(order)))
    edges = placed.groupBy(*partition, part).agg(edge.alias(found))
    over = Window.partitionBy(*partition).orderBy(F.desc(part) if backward else F.asc(part)).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*[F.col(c).alias(f"{c}_key") for c in [*partition, part]], F.last(found, ignorenulls=True).over(over).alias(found))
    own = placed.withColumn(column, within)
    same = reduce(Column.__and__, [own[c].eqNullSafe(edges[f"{c}_key"]) for c in [*partition, part]])
    return own.join(edges, same).select(*[F.coalesce(own[c], edges[found]).alias(c) if c == column else own[c] for c in df.columns])


def lagged_steps(df: DataFrame, partition: list[str], order: str, column: str) -> DataFrame:
    """partition, step: a column's value less the one before it in the order, for all rows but a partition's first."""
    (part,) = fresh(df, "range")
    placed = in_ranges(df, order, part)
    w = Window.partitionBy(*partition, part).orderBy(order)
    within = placed.select(*partition, (F.col(column) - F.lag(column).over(w)).alias("step"))
    ends = placed.groupBy(*partition, part).agg(F.min_by(column, order).alias("low"), F.max_by(column, order).alias("high"))
    over = (Window.partitionBy(*partition) if partition else Window.partitionBy()).orderBy(part)  # a row for each range
    return within.unionByName(ends.select(*partition, (F.col("low") - F.lag("high").over(over)).alias("step"))).where("step is not null")
