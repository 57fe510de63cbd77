"""Agreement of annotators and metrics of labelers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.ranges import ranked


def multi_rated(a: DataFrame, sample: str = "sample_id", label: str = "label") -> DataFrame:
    """sample, n, labels of samples with two ratings or more."""
    return a.groupBy(sample).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels")).where("n > 1")


def percent_agreement(a: DataFrame, sample: str = "sample_id", label: str = "label") -> DataFrame:
    """The share, in per cent, of samples with several ratings that have one label."""
    return multi_rated(a, sample, label).agg((100 * F.avg((F.col("labels") == 1).cast("int"))).alias("percent_agreement"))


def cohen_kappa(a: DataFrame, one, other, sample: str = "sample_id", annotator: str = "annotator_id", label: str = "label") -> DataFrame:
    """kappa of two annotators on samples both rated; 1 where chance agreement is 1, null without such samples."""
    x = a.where(F.col(annotator) == one).select(sample, F.col(label).alias("x"))
    y = a.where(F.col(annotator) == other).select(sample, F.col(label).alias("y"))
    pairs = x.join(y, sample).groupBy("x", "y").agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    mx = pairs.groupBy(F.col("x").alias("l")).agg(F.sum("n").alias("a"))
    my = pairs.groupBy(F.col("y").alias("l")).agg(F.sum("n").alias("b"))
    pe = mx.join(my, "l").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("both"))
    po, chance = F.col("same") / F.col("t"), F.col("both") / (F.col("t") * F.col("t"))
    return total.crossJoin(pe).select(F.when(chance >= 1, 1.0).when(po.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (po - chance) / (1 - chance)))).alias("kappa"))


def fleiss_kappa(a: DataFrame, raters: int, sample: str = "sample_id", label: str = "label") -> DataFrame:
    """kappa over samples with exactly ``raters`` ratings."""
    counts = a.groupBy(sample, label).agg(F.count("*").alias("c"))
    per = counts.groupBy(sample).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where(F.col("n") == raters)
    shares = counts.join(per.select(sample), sample, "left_semi").groupBy(label).agg(F.sum("c").alias("c"))
    total = shares.agg(F.sum("c").alias("t"))
    pe = shares.crossJoin(total).agg(F.sum((F.col("c") / F.col("t")) * (F.col("c") / F.col("t"))).alias("pe"))
    pm = per.agg(F.avg(F.col("same") / (raters * (raters - 1))).alias("pm"))
    return pm.crossJoin(pe).select(F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("pm") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def krippendorff_alpha(a: DataFrame, sample: str = "sample_id", label: str = "label") -> DataFrame:
    """Nominal alpha from coincidences of different ratings of a sample."""
    counts = a.where(F.col(label).isNotNull()).groupBy(sample, label).agg(F.count("*").alias("c"))
    per = counts.groupBy(sample).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("n > 1")
    observed = per.agg(F.sum((F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") - 1)).alias("d"), F.sum("n").alias("t"))
    totals = counts.join(per.select(sample), sample, "left_semi").groupBy(label).agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    expected = (F.col("t") * F.col("t") - F.col("sq")) / (F.col("t") - 1)
    return observed.crossJoin(totals).select(F.when(expected > 0, 1 - F.col("d") / F.when(expected > 0, expected)).when(expected == 0, 1.0).alias("alpha"))


def pairwise_agreement(a: DataFrame, sample: str = "sample_id", annotator: str = "annotator_id", label: str = "label") -> DataFrame:
    """annotator, agreement: the share of others' ratings of the same samples with the same label.

    Counted from label counts of each sample, not from pairs of ratings.
    """
    own = a.groupBy(annotator, sample, label).agg(F.count("*").alias("c"))
    by_annotator = own.groupBy(annotator, sample).agg(F.sum("c").alias("ca"))
    by_label = own.groupBy(sample, label).agg(F.sum("c").alias("cl"))
    total = by_label.groupBy(sample).agg(F.sum("cl").alias("n"))
    j = own.join(by_label, [sample, label]).join(by_annotator, [annotator, sample]).join(total, sample)
    g = j.groupBy(annotator).agg(F.sum(F.col("c") * (F.col("cl") - F.col("c"))).alias("same"), F.sum(F.col("c") * (F.col("n") - F.col("ca"))).alias("others"))
    return g.where("others > 0").select(annotator, (F.col("same") / F.col("others")).alias("agreement"))


def problematic_samples(a: DataFrame, sample: str = "sample_id", label: str = "label", least: float = 0.6) -> DataFrame:
    """sample, ratings, agreement_ratio of samples whose commonest label has too small a share."""
    c = a.groupBy(sample, label).agg(F.count("*").alias("c")).groupBy(sample).agg(F.sum("c").alias("ratings"), F.max("c").alias("top"))
    return c.where(F.col("ratings") > 1).select(sample, "ratings", (F.col("top") / F.col("ratings")).alias("agreement_ratio")).where(F.col("agreement_ratio") < least)


def majority_vote(a: DataFrame, sample: str = "sample_id", label: str = "label", weight: Column | None = None) -> DataFrame:
    """sample, label, votes: the label of most (weighted) votes; null where two share the lead."""
    c = a.groupBy(sample, label).agg(F.sum(F.lit(1) if weight is None else weight).alias("votes"))
    top = c.groupBy(sample).agg(F.max("votes").alias("votes"))
    return c.join(top, [sample, "votes"]).groupBy(sample, "votes").agg(F.count("*").alias("k"), F.min(label).alias("label")).select(sample, F.when(F.col("k") == 1, F.col("label")).alias("label"), "votes")


def resolved(a: DataFrame, strategy: str = "majority", sample: str = "sample_id", label: str = "label", weight: str = "weight", confidence: str = "confidence", role: str = "role", experts: tuple[str, ...] = ("expert", "admin")) -> DataFrame:
    """sample, label, support, by: one label for each sample by votes.

    ``majority``: the label of most votes. ``weighted``: of the largest sum of
    weight times confidence. ``expert``: of most votes of experts, where there
    are any, else of all. ``consensus``: the label of all votes, if it is one.
    Null where two labels share the lead or there is no consensus; null labels
    are no votes; null weights and confidences count as 1. ``support`` is the
    label's share of what was summed, ``by`` whose votes decided. Votes are
    rounded to twelve places and summed exactly, so that neither leads nor
    shares depend on the order of rows.
    """
    votes = a.where(F.col(label).isNotNull())
    one = F.lit(1.0)
    if strategy == "weighted":
        one = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) * F.coalesce(F.col(confidence).cast("double"), F.lit(1.0))
    one = one.cast("decimal(28,12)")
    expert = F.coalesce(F.col(role).isin(*experts), F.lit(False)) if strategy == "expert" else F.lit(False)
    sums = votes.groupBy(sample, label).agg(F.sum(one).alias("all"), F.sum(F.when(expert, one).otherwise(F.lit(0).cast("decimal(28,12)"))).alias("own"))
    whole = sums.groupBy(sample).agg(F.sum("all").alias("n"), F.sum("own").alias("n_own"), F.max("all").alias("top"), F.max("own").alias("top_own"))
    j = sums.join(whole, sample)
    decided = F.col("n_own") > 0
    leads = F.when(decided, F.col("own") == F.col("top_own")).otherwise(F.col("all") == F.col("top"))
    share = F.when(decided, ratio(F.col("top_own"), F.col("n_own"))).otherwise(ratio(F.col("top"), F.col("n")))
    best = j.where(leads).groupBy(sample).agg(F.count("*").alias("k"), F.min(label).alias("label"), F.max(share).alias("support"), F.max(F.when(decided, "experts").otherwise("all")).alias("by"))
    alone = F.col("k") == 1
    if strategy == "consensus":
        alone = alone & (F.col("support") >= 1 - 1e-12)
    return best.select(sample, F.when(alone, F.col("label")).alias("label"), "support", "by")


def labeler_metrics(a: DataFrame, labeler: str = "labeler_id", task: str = "task_id", label: str = "label", truth: str = "ground_truth") -> DataFrame:
    """labeler, tasks, accuracy (0.5 without truth), agreement (0.5 without peers), expertise, percentile of accuracy."""
    own = a.groupBy(labeler).agg(F.count("*").alias("tasks"), F.coalesce(F.avg((F.col(label) == F.col(truth)).cast("int")), F.lit(0.5)).alias("accuracy"))
    peers = pairwise_agreement(a, task, labeler, label)
    m = own.join(peers, labeler, "left").select(labeler, "tasks", "accuracy", F.coalesce("agreement", F.lit(0.5)).alias("agreement"))
    level = F.when((F.col("accuracy") >= 0.95) & (F.col("tasks") >= 1000), "master").when((F.col("accuracy") >= 0.9) & (F.col("tasks") >= 500), "expert").when((F.col("accuracy") >= 0.8) & (F.col("tasks") >= 100), "intermediate").otherwise("novice")
    return m.withColumn("expertise", level).withColumn("percentile", F.cume_dist().over(Window.orderBy("accuracy")))


def category_consistency(a: DataFrame, labeler: str = "labeler_id", category: str = "category", label: str = "label") -> DataFrame:
    """labeler, consistency: the mean over categories of the share of the labeler's commonest label."""
    c = a.groupBy(labeler, category, label).agg(F.count("*").alias("c")).groupBy(labeler, category).agg((F.max("c") / F.sum("c")).alias("share"))
    return c.groupBy(labeler).agg(F.avg("share").alias("consistency"))


def category_skill(a: DataFrame, labeler: str = "labeler_id", category: str = "category", label: str = "label", truth: str = "ground_truth", least: int = 5) -> DataFrame:
    return a.groupBy(labeler, category).agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col(truth)).cast("int")).alias("accuracy")).where(F.col("n") >= least)


def half_trend(a: DataFrame, labeler: str = "labeler_id", order: str = "ts", label: str = "label", truth: str = "ground_truth") -> DataFrame:
    """labeler, early, late, trend: accuracy of the first and second half of a labeler's work."""
    rows = ranked(a.select(labeler, order, (F.col(label) == F.col(truth)).cast("int").alias("ok")), [labeler], order, "place")
    rows = rows.join(a.groupBy(labeler).agg(F.count("*").alias("all")), labeler).select(labeler, (F.col("place") * 2 <= F.col("all")).alias("first"), "ok")
    g = rows.groupBy(labeler).agg(F.avg(F.when(F.col("first"), F.col("ok"))).alias("early"), F.avg(F.when(~F.col("first"), F.col("ok"))).alias("late"))
    change = F.col("late") - F.col("early")
    return g.withColumn("trend", F.when(change > 0.05, "improving").when(change < -0.05, "declining").otherwise("stable"))


def route(tasks: DataFrame, metrics: DataFrame, skill: DataFrame, task: str = "task_id", labeler: str = "labeler_id", category: str = "category", top: int = 2, least_accuracy: float = 0.0) -> DataFrame:
    """task, labeler, score, rank: .4 accuracy + .2 consistency + .1 availability + .3 skill in the category (.15 if unknown).

    Labelers are ranked once a category, not once a task.
    """
    kinds = tasks.select(category).distinct()
    able = metrics.where(F.col("accuracy") >= least_accuracy)
    s = kinds.crossJoin(F.broadcast(able)).join(skill.select(labeler, category, F.col("accuracy").alias("own")), [labeler, category], "left")
    score = 0.4 * F.col("accuracy") + 0.2 * F.col("consistency") + 0.1 + F.coalesce(0.3 * F.col("own"), F.lit(0.15))
    best = s.select(category, labeler, score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("score"), labeler))).where(F.col("rank") <= top)
    return tasks.join(F.broadcast(best), category).select(task, labeler, "score", "rank")


def review_queue(a: DataFrame, most: int = 100, sample: str = "sample_id", label: str = "label") -> DataFrame:
    """Samples of least agreement first."""
    return problematic_samples(a, sample, label, 1.01).orderBy("agreement_ratio", sample).limit(most)


def accuracy(a: DataFrame, annotator: str = "annotator_id", label: str = "label", truth: str = "ground_truth") -> DataFrame:
    return a.groupBy(annotator).agg(ratio(F.count_if(F.col(label) == F.col(truth)), F.count(truth)).alias("accuracy"))
