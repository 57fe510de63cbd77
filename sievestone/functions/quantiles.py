"""Exact quantiles of columns of any size, by linear interpolation between order statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import ranked

#: Values that one final list may hold.
LIST_LIMIT = 200_000


@dataclass
class _Statistic:
    """The value of a rank from 0 in a column: the bracket that it lies in, what lies below and inside of it, and how far the next one reaches."""

    column: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    slack: float = 0.001
    value: float | None = None

    def cell(self) -> Column:
        c = F.col(self.column)
        return c if self.low is None else F.when(c.between(self.low, self.high), c)


def _order_statistics(df: DataFrame, wanted: list[_Statistic]) -> None:
    """Fills in the values. Brackets from sketches are narrowed, all of them in common scans, until what they hold fits in one bounded list."""
    share = max(1000, LIST_LIMIT // max(1, len(wanted)))
    while open_ := [w for w in wanted if w.value is None and w.inside > share]:
        at = [(w.rank - w.below) / max(1, w.inside - 1) for w in open_]
        found = df.agg(*[F.percentile_approx(w.cell(), [max(0.0, p - w.slack), min(1.0, p + w.slack)], 10_000) for w, p in zip(open_, at, strict=True)]).first()
        counts = df.agg(*[x for w, (a, b) in zip(open_, found, strict=True) for x in (F.count_if(F.col(w.column) < a), F.count_if(F.col(w.column).between(a, b)))]).first()
        for i, (w, (a, b)) in enumerate(zip(open_, found, strict=True)):
            less, between = counts[2 * i], counts[2 * i + 1]
            if not less <= w.rank < less + between:
                w.slack *= 4
            elif a == b:
                w.value = float(a)
            elif between == w.inside:
                w.inside = 0  # few values, each many times: they fit in a list
            else:
                w.low, w.high, w.below, w.inside, w.slack = a, b, less, between, 0.001
    left = [w for w in wanted if w.value is None]
    if not left:
        return
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), w.cell().alias("v")) for i, w in enumerate(left)]))
    rows = df.select(cells).where("v is not null").groupBy("i", "v").count().orderBy("i", "v").limit(2 * LIST_LIMIT + 1000 * len(left)).collect()
    for i, w in enumerate(left):
        seen = w.below
        for r in rows:
            if r["i"] == i and w.value is None:
                seen += r["count"]
                if w.rank < seen:
                    w.value = float(r["v"])
        if w.value is None:
            raise ValueError(f"rank {w.rank} of {w.column} not found")


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """For each column its quantiles, as numpy and pandas compute them; None for columns without values.

    Nulls are left out. A table of up to ``LIST_LIMIT`` rows takes one pass for
    all columns; a larger one a few scans, as many for all columns as for one,
    and the driver holds a bounded list.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    if max(counts, default=0) <= LIST_LIMIT:
        row = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, probabilities))).alias(c) for c in columns]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probabilities) for c in columns}
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    places = {(c, k): None for c in columns if counts[c] for p in probabilities for k in (math.floor(p * (counts[c] - 1)), math.ceil(p * (counts[c] - 1)))}
    wanted = {(c, k): _Statistic(f"v{columns.index(c)}", k, counts[c]) for c, k in places}
    _order_statistics(values, list(wanted.values()))

    def between(c: str, p: float) -> float | None:
        if not counts[c]:
            return None
        at = p * (counts[c] - 1)
        low, high = wanted[c, math.floor(at)].value, wanted[c, math.ceil(at)].value
        return low if low == high else low + (high - low) * (at - math.floor(at))

    return {c: [between(c, p) for p in probabilities] for c in columns}


def grouped_quantiles(df: DataFrame, group: str, columns: list[str], probabilities: list[float]) -> DataFrame:
    """group, and of each column an array of the group's quantiles under the column's name; exact, null groups are one more.

    Values are ranked over ranges of their order, so no task holds a group; only
    the order statistics that the quantiles lie between come out of that. All
    columns go through one ranking, a row for each value.
    """
    values = df.select(F.col(group).alias("g"), F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))).where("v is not null")
    sizes = values.groupBy("g", "c").agg(F.count("*").alias("n"))
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(probabilities)]))
    wanted = sizes.select(F.col("g").alias("own_g"), F.col("c").alias("own_c"), points.alias("w")).select("own_g", "own_c", "w.p", "w.at")
    ends = wanted.select("own_g", "own_c", "p", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("place"))
    rows = ranked(values, ["g", "c"], "v", "rank")
    same = rows["g"].eqNullSafe(ends["own_g"]) & (rows["c"] == ends["own_c"]) & (rows["rank"] - 1 == ends["place"])
    share = F.max(F.col("at") - F.floor("at"))
    found = rows.join(ends, same).groupBy("own_g", "own_c", "p").agg((F.min("v") + (F.max("v") - F.min("v")) * share).alias("q"))
    whole = found.groupBy("own_g", "own_c").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "q"))), lambda x: x["q"]).alias("q"))
    arrays = whole.groupBy("own_g").agg(*[F.max(F.when(F.col("own_c") == i, F.col("q"))).alias(c) for i, c in enumerate(columns)])
    every = df.select(F.col(group).alias(group)).distinct()
    joined = every.join(arrays, every[group].eqNullSafe(arrays["own_g"]), "left")
    return joined.select(every[group], *[arrays[c] for c in columns])
