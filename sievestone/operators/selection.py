"""What to look at or train on next: active learning, curricula, model-aware scores, committees, priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio


def _sorted(probs: Column) -> Column:
    return F.sort_array(probs, asc=False)


def uncertainty(probs: Column) -> Column:
    return 1 - F.array_max(probs)


def margin(probs: Column) -> Column:
    return _sorted(probs)[0] - F.coalesce(F.get(_sorted(probs), F.lit(1)), F.lit(0.0))


def entropy(probs: Column) -> Column:
    return F.aggregate(probs, F.lit(0.0), lambda s, p: s - p * F.ln(p + 1e-10))


def model_change(probs: Column) -> Column:
    """The Gini impurity of the probabilities."""
    return F.aggregate(probs, F.lit(0.0), lambda s, p: s + p * (1 - p))


def pick(df: DataFrame, key: str, probs: str, k: int, strategy: str = "uncertainty") -> DataFrame:
    """key, score of the k rows most worth a label, ties to the smaller key."""
    p = F.col(probs)
    score = {"uncertainty": uncertainty(p), "margin": -margin(p), "entropy": entropy(p), "model_change": model_change(p), "random": F.pmod(F.xxhash64(key, F.lit(42)), F.lit(1_000_000)) / 1e6}[strategy]
    return df.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def vote_entropy(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """key, score: the entropy of a committee's votes on each row."""
    c = votes.groupBy(key, vote).agg(F.count("*").alias("c"))
    n = F.sum("c").over(Window.partitionBy(key))
    return c.withColumn("p", F.col("c") / n).groupBy(key).agg(F.sum(-F.col("p") * F.ln("p")).alias("score"))


def corrected_weights(scores: DataFrame, corrections: DataFrame, key: str, label: str) -> DataFrame:
    """Scores times 1 + .1 min(10, past corrections of the same label)."""
    past = corrections.groupBy(label).agg(F.count("*").alias("past"))
    joined = scores.join(F.broadcast(past), label, "left")
    return joined.select(key, (F.col("score") * (1 + 0.1 * F.least(F.coalesce("past", F.lit(0)), F.lit(10)))).alias("score"))


def model_aware(df: DataFrame, key: str, label: str, probs: str, threshold: float = 0.5) -> DataFrame:
    """key, predicted, confidence, margin, score, impact: 100 - 30 if wrong - 50 (threshold - confidence) - 15 for a margin under .2."""
    best = F.array_max(probs)
    guess = (F.array_position(probs, best) - 1).cast("int")
    wrong = guess != F.col(label)
    rows = df.select(key, F.col(label).alias("label"), guess.alias("predicted"), best.alias("confidence"), margin(F.col(probs)).alias("margin"), wrong.alias("wrong"))
    score = 100 - F.when(F.col("wrong"), 30.0).otherwise(0.0) - 50 * F.greatest(F.lit(0.0), threshold - F.col("confidence")) - F.when(F.col("margin") < 0.2, 15.0).otherwise(0.0)
    impact = F.when(F.col("wrong") & (F.col("confidence") > 0.8), "critical").when(F.col("wrong"), "high").when(F.col("margin") < 0.2, "medium").otherwise("low")
    return rows.select(key, "label", "predicted", "confidence", "margin", F.greatest(F.lit(0.0), score).alias("score"), impact.alias("impact"))


def class_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """label, n, precision, recall, f1, quality = 40 accuracy + 20 precision + 20 recall + 20 (1 - confusion)."""
    c = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    rows = c.groupBy(F.col("y").alias("label")).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"), F.max(F.when(F.col("y") != F.col("p"), F.col("c")).otherwise(0)).alias("worst"))
    cols = c.groupBy(F.col("p").alias("label")).agg(F.sum("c").alias("np"))
    j = rows.join(cols, "label", "left").fillna(0, ["np"])
    pr, rc = ratio(F.col("tp"), F.col("np")), ratio(F.col("tp"), F.col("n"))
    return j.select("label", "n", pr.alias("precision"), rc.alias("recall"), ratio(2 * pr * rc, pr + rc).alias("f1"), (40 * rc + 20 * pr + 20 * rc + 20 * (1 - ratio(F.col("worst"), F.col("n")))).alias("quality"))


def confusions(df: DataFrame, label: str, predicted: str, over: float = 0.1) -> DataFrame:
    """label, predicted, rate of confusions over a share of the class."""
    c = df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("label")
    return c.withColumn("rate", F.col("c") / F.sum("c").over(w)).where((F.col("label") != F.col("predicted")) & (F.col("rate") > over)).select("label", "predicted", "rate")


def difficulty(parts: dict[str, Column]) -> Column:
    """The weighted sum of a row's difficulty by quality .4, confidence .3, neighbours .2, outlier .1."""
    weights = {"quality": 0.4, "confidence": 0.3, "neighbours": 0.2, "outlier": 0.1}
    return reduce(Column.__add__, [parts[k] * w for k, w in weights.items() if k in parts])


def curriculum(df: DataFrame, key: str, hardness: str, epochs: int = 10, initial: float = 0.3, growth: float = 1.5) -> DataFrame:
    """epoch, rows, hardest: how many of the easiest rows each epoch trains on, and the hardest of them.

    The share is initial * growth^epoch, 1 at most. Cut-offs come from exact
    quantiles, so nothing is ranked over the whole table.
    """
    from ..functions.quantiles import quantiles

    n = df.count()
    counts = [max(1, int(n * min(1.0, initial * growth**e))) for e in range(epochs)] if n else []
    cuts = quantiles(df, [hardness], [(c - 1) / max(1, n - 1) for c in counts])[hardness] if n else []
    return df.sparkSession.createDataFrame([(e, c, float(q)) for e, (c, q) in enumerate(zip(counts, cuts, strict=True))], "epoch int, rows long, hardest double")


def self_paced(loss: Column, epoch: int, epochs: int = 10, start: float = 0.1, kind: str = "linear") -> Column:
    """Whether a row's loss lies under the pace of an epoch."""
    import math

    t = epoch / max(1, epochs - 1)
    pace = {"linear": start + (1 - start) * t, "log": start + (1 - start) * math.log1p(t * (math.e - 1)), "exp": start * (1 / start) ** t}[kind]
    return loss <= pace


def priorities(issues: DataFrame, key: str, kind: str, weights: dict[str, float], top: int = 20) -> DataFrame:
    """key, priority: the sum of an item's issue weights, largest first."""
    table = issues.sparkSession.createDataFrame(list(weights.items()), "__kind string, __w double")
    g = issues.join(F.broadcast(table), F.col(kind) == F.col("__kind")).groupBy(key).agg(F.sum("__w").alias("priority"))
    return g.orderBy(F.desc("priority"), key).limit(top)


def predicted_impact(issues: DataFrame, kind: str, confidence: str) -> DataFrame:
    """kind, n, gain: expected accuracy gained, factor times confidence summed, 0.15 at most."""
    factors = [("label_error", 0.015), ("duplicate", 0.002), ("outlier", 0.005), ("missing", 0.001)]
    table = issues.sparkSession.createDataFrame(factors, "__kind string, __f double")
    g = issues.join(F.broadcast(table), F.col(kind) == F.col("__kind")).groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("__f") * F.coalesce(confidence, F.lit(0.5))).alias("gain"))
    return g.select("kind", "n", F.least(F.lit(0.15), "gain").alias("gain"))


def breadth_first(edges: DataFrame, start: DataFrame, most: int = 5) -> DataFrame:
    """node, depth of everything within ``most`` directed steps, each with its least depth."""
    seen = start.select("node", F.lit(0).alias("depth"))
    for d in range(1, most + 1):
        step = seen.where(F.col("depth") == d - 1).join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        seen = seen.unionByName(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
    return seen
