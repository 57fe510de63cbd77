"""The graph of issues, rows and what they belong to, and what fixing issues does along its edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import add_all
from ..functions.working import written

#: Gain of each metric for an issue of a kind that is fixed, and the most that fixes gain together.
FACTORS = {
    "label_error": {"accuracy": 0.015, "precision": 0.012, "recall": 0.012, "f1": 0.012},
    "duplicate": {"accuracy": 0.002, "precision": 0.003, "recall": 0.001, "f1": 0.002},
    "outlier": {"accuracy": 0.005, "precision": 0.004, "recall": 0.003, "f1": 0.004},
    "missing": {"accuracy": 0.001, "precision": 0.001, "recall": 0.001, "f1": 0.001},
}
MOST = 0.15
METRICS = ("accuracy", "precision", "recall", "f1")
#: Tasks that a node's edges are spread over.
SPLITS = 16


def issue_nodes(issues: dict[str, DataFrame], key: str) -> DataFrame:
    """node, kind, key, confidence of issue tables by kind; a table without a confidence has one half. Issues of one kind and key are one, at their highest."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), (F.col("confidence") if "confidence" in df.columns else F.lit(None)).cast("double").alias("confidence")) for kind, df in issues.items()]
    every = reduce(DataFrame.unionByName, parts).where("key is not null")
    one = every.groupBy("kind", "key").agg(F.coalesce(F.max("confidence"), F.lit(0.5)).alias("confidence"))
    return one.select(F.concat_ws(":", F.lit("issue"), "kind", "key").alias("node"), "kind", "key", "confidence")


def edges(nodes: DataFrame, rows: DataFrame, key: str, belongs: dict[str, str]) -> DataFrame:
    """source, target, kind, weight: issues affect rows by their confidence, rows belong to what their columns name, in full.

    ``belongs``: of each kind of node a column. Null values make no edge.
    """
    row = F.concat_ws(":", F.lit("row"), F.col(key).cast("string"))
    out = [nodes.select(F.col("node").alias("source"), F.concat_ws(":", F.lit("row"), "key").alias("target"), F.lit("affects").alias("kind"), F.col("confidence").alias("weight"))]
    for kind, column in belongs.items():
        out.append(rows.where(F.col(column).isNotNull()).select(row.alias("source"), F.concat_ws(":", F.lit(kind), F.col(column).cast("string")).alias("target"), F.lit("belongs").alias("kind"), F.lit(1.0).alias("weight")))
    return reduce(DataFrame.unionByName, out)


def propagated(start: DataFrame, links: DataFrame, masses: list[str], depth: int = 3, decay: float = 1.0) -> DataFrame:
    """node and ``masses``: sums over all paths of at most ``depth`` edges from the start of the start's masses times the weights on the path, ``decay`` a step.

    ``start``: node and the masses. Paths that meet in a node go on as one sum,
    so a step is a join and an aggregation with map-side sums, however many
    paths there are; a hub's edges are spread over ``SPLITS`` tasks. Every step
    is a written table. Loops count as often as paths run through them.
    """
    spread = links.select("source", "target", "weight").where("weight <> 0").withColumn("split", F.pmod(F.xxhash64("target"), F.lit(SPLITS)).cast("int"))
    now = start.groupBy("node").agg(*[F.sum(m).alias(m) for m in masses])
    steps = [now]
    for _ in range(depth):
        out = now.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))).withColumnRenamed("node", "source")
        met = out.join(spread, ["source", "split"]).groupBy(F.col("target").alias("node"))
        now = written(met.agg(*[F.sum(F.col(m) * F.col("weight") * decay).alias(m) for m in masses]))
        steps.append(now)
    return reduce(DataFrame.unionByName, steps).groupBy("node").agg(*[F.sum(m).alias(m) for m in masses])


def _gain(metric: str) -> Column:
    return add_all([F.when(F.col("kind") == k, F.lit(v[metric])).otherwise(0.0) for k, v in FACTORS.items()], F.lit(0.0))


def fix_impact(nodes: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """node, accuracy, precision, recall, f1 of every node that fixing the issues of ``nodes`` reaches: factors times weights along all paths.

    The start's mass is an issue's factor; the issue's edge carries its
    confidence. Issues themselves and kinds without factors are left out.
    """
    start = nodes.where(F.col("kind").isin(*FACTORS)).select("node", *[_gain(m).alias(m) for m in METRICS])
    return propagated(start, links, list(METRICS), depth).where(~F.col("node").startswith("issue:"))


def whole_impact(nodes: DataFrame) -> DataFrame:
    """One row: issues, rows, and the gain of each metric when all are fixed, ``MOST`` at most, and the confidence in it."""
    gains = [F.least(F.lit(MOST), F.coalesce(F.sum(_gain(m) * F.col("confidence")), F.lit(0.0))).alias(m) for m in METRICS]
    confidence = F.when(F.count("*") == 0, 1.0).otherwise(F.least(F.lit(0.95), 0.5 + 0.01 * F.count("*")))
    return nodes.agg(F.count("*").alias("issues"), F.count_distinct("key").alias("rows"), *gains, confidence.alias("confidence"))
