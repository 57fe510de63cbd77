"""Rows that stand for a table: centres that cover it, and weighted draws without replacement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.working import written

LAYOUT = "key long, v array<double>"


def farthest_first(keys: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Places of k centres: the row of the least key, then always the row farthest from all centres, ties to the smaller key; fewer if no row is off them."""
    order = np.argsort(keys, kind="stable")
    points = points[order]
    out, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(out) < k and far.max() > 0:
        out.append(int(np.argmax(far)))
        far = np.minimum(far, ((points - points[out[-1]]) ** 2).sum(axis=1))
    return order[out]


def _blocks(rows: DataFrame, k: int, block: int) -> DataFrame:
    """The centres of each block of rows of a task; a task holds one block."""

    def reduce(batches):
        keys, points = [], []

        def centres():
            at = farthest_first(np.array(keys), np.array(points), k)
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.int64()), pa.array([points[i] for i in at], pa.list_(pa.float64()))], ["key", "v"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(i)
                points.append(v)
                if len(keys) >= block:
                    yield centres()
                    keys, points = [], []
        if keys:
            yield centres()

    return rows.mapInArrow(reduce, LAYOUT)


def k_centers(vectors: DataFrame, key: str, vector: str, k: int, block: int = 20_000) -> DataFrame:
    """key, v, place: k rows such that no row is far from all of them, by rounds of greedy choice in blocks.

    One block gives a radius of at most twice the best; each round of blocks
    before it adds two more times that. What is left after a round is k rows a
    block, and the last round sees one block. Null vectors and keys take no
    part; the rows chosen are the same for the same layout of the table.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null and v is not null")
    block = max(block, 2 * k)
    left = written(_blocks(rows, k, block))
    n = left.count()
    while n > block:
        left = written(_blocks(left.repartition(-(-n // block), "key"), k, block))
        n = left.count()
    last = _blocks(left.coalesce(1), k, block + 1).withColumn("place", F.monotonically_increasing_id().cast("int"))
    return last


def covered(vectors: DataFrame, key: str, vector: str, centres: DataFrame) -> DataFrame:
    """key, centre, distance: each row's nearest centre; the centres, a chosen number of rows, go to every task."""
    chosen = sorted((r["key"], r["v"]) for r in centres.select("key", "v").collect())  # k rows
    names, points = np.array([c[0] for c in chosen], np.int64), np.array([c[1] for c in chosen], float)

    def nearest(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array(part.column(1).to_pylist(), float)
                d = np.stack([((x - p) ** 2).sum(axis=1) for p in points], axis=1)
                best = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best]), pa.array(np.sqrt(d[np.arange(len(x)), best]))], ["key", "centre", "distance"])

    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null and v is not null")
    return rows.mapInArrow(nearest, "key long, centre long, distance double")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1] that depends on a key and a seed alone."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return (F.conv(F.substring(text, 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """key, weight, draw: n rows without replacement, each next one with a chance in proportion to its weight.

    Rows of positive weight draw -ln(u) / weight, and the n least draws are the
    sample, so one pass and a bounded heap in each task do; the same seed gives
    the same rows. Null, zero and negative weights are never drawn. A sampling
    operator: its limit is its purpose.
    """
    draw = -F.ln(uniform(F.col(key), seed)) / F.col(weight)
    return df.where(F.col(weight) > 0).select(key, F.col(weight).alias("weight"), draw.alias("draw")).orderBy("draw", key).limit(n)
