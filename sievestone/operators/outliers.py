"""Outliers by z-score, IQR fences, votes, isolation trees and local density."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import add_all, zero_filled
from ..functions.quantiles import quantiles
from ..functions.working import written


def column_stats(df: DataFrame, columns: list[str], quartiles: bool = True) -> dict[str, dict[str, float]]:
    """mean, std (population) and, if asked for, q1, q3 of every column with nulls as 0: a few numbers a column, for use as literals."""
    filled = df.select(*[zero_filled(c).alias(c) for c in columns])
    row = filled.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]).first()
    q = quantiles(filled, columns, [0.25, 0.75]) if quartiles else dict.fromkeys(columns, (None, None))
    return {c: {"mean": row[c]["mean"], "std": row[c]["std"], "q1": q[c][0], "q3": q[c][1]} for c in columns if row[c]["mean"] is not None}


def z_sizes(stats: dict, columns: list[str]) -> list[tuple[str, Column]]:
    return [(c, F.abs((zero_filled(c) - s["mean"]) / s["std"])) for c in columns if (s := stats.get(c)) and s["std"]]


def fence_distances(stats: dict, columns: list[str], multiplier: float = 1.5) -> list[tuple[str, Column]]:
    """How far beyond its fences a value lies, in IQRs; 0 within."""
    out = []
    for c in columns:
        s = stats.get(c)
        if s and (iqr := s["q3"] - s["q1"]) > 0:
            low, high, v = s["q1"] - multiplier * iqr, s["q3"] + multiplier * iqr, zero_filled(c)
            out.append((c, F.when(v < low, (low - v) / iqr).when(v > high, (v - high) / iqr).otherwise(F.lit(0.0))))
    return out


def _contributing(parts: list[tuple[str, Column]], least: float) -> Column:
    names = F.array(*[F.when(x > least, F.lit(c)) for c, x in parts])
    return F.array_join(F.array_sort(F.array_compact(names)), ",")


def zscore(df: DataFrame, key: str, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """key, score, features of rows with |z| over the threshold in any column; score is the mean of those |z|."""
    parts = z_sizes(column_stats(df, columns, quartiles=False), columns)
    if not parts:
        return df.limit(0).select(key, F.lit(0.0).alias("score"), F.lit("").alias("features"))
    over = add_all([F.when(x > threshold, 1).otherwise(0) for _, x in parts])
    total = add_all([F.when(x > threshold, x).otherwise(0.0) for _, x in parts], F.lit(0.0))
    return df.where(over > 0).select(key, (total / over).alias("score"), _contributing(parts, threshold).alias("features"))


def iqr(df: DataFrame, key: str, columns: list[str], multiplier: float = 1.5) -> DataFrame:
    """key, score, features of rows beyond the fences of any column, on raw values; score is the mean distance in IQRs over all columns with spread."""
    parts = fence_distances(column_stats(df, columns), columns, multiplier)
    if not parts:
        return df.limit(0).select(key, F.lit(0.0).alias("score"), F.lit("").alias("features"))
    total = add_all([x for _, x in parts], F.lit(0.0))
    return df.where(total > 0).select(key, (total / len(parts)).alias("score"), _contributing(parts, 0.0).alias("features"))


def ensemble(df: DataFrame, key: str, columns: list[str], threshold: float = 3.0, multiplier: float = 1.5, least_votes: int = 2, forest: DataFrame | None = None) -> DataFrame:
    """key, votes, score of rows that at least ``least_votes`` of z-score, IQR and, if given, an isolation forest's (key, score, is_outlier) find."""
    stats = column_stats(df, columns)
    z, fences = z_sizes(stats, columns), fence_distances(stats, columns, multiplier)
    z_hit = F.greatest(F.lit(0.0), F.lit(0.0), *[x for _, x in z]) > threshold
    f_hit = F.greatest(F.lit(0.0), F.lit(0.0), *[x for _, x in fences]) > 0
    over = add_all([F.when(x > threshold, 1).otherwise(0) for _, x in z])
    z_score = F.when(over > 0, add_all([F.when(x > threshold, x).otherwise(0.0) for _, x in z], F.lit(0.0)) / over)
    f_score = F.when(f_hit, add_all([x for _, x in fences], F.lit(0.0)) / max(1, len(fences)))
    rows = df.select(key, z_hit.cast("int").alias("z"), f_hit.cast("int").alias("f"), z_score.alias("zs"), f_score.alias("fs"))
    if forest is not None:
        rows = rows.join(forest.select(key, F.col("is_outlier").cast("int").alias("t"), F.when(F.col("is_outlier"), F.col("score")).alias("ts")), key, "left")
    else:
        rows = rows.withColumns({"t": F.lit(0), "ts": F.lit(None).cast("double")})
    votes = F.col("z") + F.col("f") + F.coalesce("t", F.lit(0))
    scores = F.array_compact(F.array("zs", "fs", "ts"))
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)
    return rows.where(votes >= least_votes).select(key, votes.alias("votes"), mean.alias("score"))


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """key, score, is_outlier by isolation trees (Liu, Ting and Zhou 2008).

    Trees are grown on samples of at most ``sample`` rows each, drawn by hash in
    one pass; the forest, a bounded model, is broadcast and scored in Arrow
    batches. The cut is the exact 1 - contamination quantile of scores.
    """
    filled = df.select(key, *[zero_filled(c).alias(c) for c in columns])
    n = df.count()
    pool = trees * sample
    share = min(1.0, 2 * pool / max(1, n))
    rows = filled.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select(*columns).limit(4 * pool).collect()
    data = np.array([list(r) for r in rows], np.float64).reshape(-1, len(columns))
    data = data[np.lexsort(data.T)] if len(data) else data
    rng = np.random.default_rng(seed)
    size = min(sample, max(1, len(data)))
    depth = int(np.ceil(np.log2(max(2, size))))

    def usual(m):
        return 0.0 if m <= 1 else 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else 1.0

    def grow(x, level):
        spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
        if level >= depth or len(x) <= 1 or not len(spread):
            return level + usual(len(x))
        j = int(rng.choice(spread))
        cut = float(rng.uniform(x[:, j].min(), x[:, j].max()))
        return j, cut, grow(x[x[:, j] < cut], level + 1), grow(x[x[:, j] >= cut], level + 1)

    forest = [grow(data[rng.choice(len(data), size, replace=False)], 0) for _ in range(trees)] if len(data) else []
    held = df.sparkSession.sparkContext.broadcast((forest, usual(size) or 1.0))

    def score(batches):
        own, scale = held.value

        def walk(tree, x, at, out):
            if not isinstance(tree, tuple):
                out[at] += tree
                return
            j, cut, low, high = tree
            left = x[at, j] < cut
            if left.any():
                walk(low, x, at[left], out)
            if not left.all():
                walk(high, x, at[~left], out)

        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]).astype(np.float64)
            out = np.zeros(len(x))
            for tree in own:
                walk(tree, x, np.arange(len(x)), out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(2 ** (-out / max(1, len(own)) / scale))], [key, "score"])

    scored = written(filled.mapInArrow(score, f"{key} {dict(df.dtypes)[key]}, score double"))  # a quantile takes several scans
    cut = quantiles(scored, ["score"], [1 - contamination])["score"][0]
    return scored.withColumn("is_outlier", F.col("score") > F.lit(cut))


def local_outlier_factor(neighbours: DataFrame, contamination: float | None = None) -> DataFrame:
    """query, lof from (query, key, distance) rows of every point's k nearest others, by joins alone.

    The reachability of a neighbour is the larger of its own k-distance and the
    distance; a point's density is the inverse of its mean reachability, and
    its factor the mean density of its neighbours over its own.
    """
    reach = neighbours.groupBy("query").agg(F.max("distance").alias("k_distance"))
    far = neighbours.join(reach.select(F.col("query").alias("key"), "k_distance"), "key")
    density = far.groupBy("query").agg((1 / (F.avg(F.greatest("distance", "k_distance")) + 1e-10)).alias("density"))
    near = neighbours.join(density.select(F.col("query").alias("key"), F.col("density").alias("other")), "key")
    lof = near.groupBy("query").agg(F.avg("other").alias("other")).join(density, "query").select("query", (F.col("other") / F.col("density")).alias("lof"))
    if contamination is None:
        return lof
    cut = quantiles(lof, ["lof"], [1 - contamination])["lof"][0]
    return lof.withColumn("is_outlier", F.col("lof") > F.lit(cut))
