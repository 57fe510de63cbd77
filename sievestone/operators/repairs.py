"""Fix suggestions and their application, review queues, tables without issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import numeric_columns
from ..functions.quantiles import quantiles

#: Least confidence of label, duplicate and outlier fixes by strategy.
STRATEGIES = {"conservative": (0.95, 0.99, 0.95), "moderate": (0.9, 0.98, 0.9), "aggressive": (0.7, 0.9, 0.7)}


def suggest(labels: DataFrame | None, duplicates: DataFrame | None, outliers: DataFrame | None, strategy: str = "moderate", keep: str = "first") -> DataFrame:
    """key, action, value, confidence, reason; one removal a key.

    ``labels``: key, predicted, confidence. ``duplicates``: key1, key2,
    similarity. ``outliers``: key, score.
    """
    l, d, o = STRATEGIES[strategy]
    parts = []
    if labels is not None:
        parts.append(labels.where(F.col("confidence") >= l).select("key", F.lit("relabel").alias("action"), F.col("predicted").cast("string").alias("value"), "confidence", F.lit("label_error").alias("reason")))
    if duplicates is not None:
        gone = F.greatest("key1", "key2") if keep == "first" else F.least("key1", "key2")
        parts.append(duplicates.where(F.col("similarity") >= d).groupBy(gone.alias("key")).agg(F.max("similarity").alias("confidence")).select("key", F.lit("remove").alias("action"), F.lit(None).cast("string").alias("value"), "confidence", F.lit("duplicate").alias("reason")))
    if outliers is not None:
        parts.append(outliers.where(F.col("score") >= o).select("key", F.lit("flag").alias("action"), F.lit(None).cast("string").alias("value"), F.col("score").alias("confidence"), F.lit("outlier").alias("reason")))
    return reduce(DataFrame.unionByName, parts)


def apply_fixes(df: DataFrame, key: str, label: str | None, fixes: DataFrame, impute: list[str] = ()) -> DataFrame:
    """The table relabelled, without removed rows, with ``is_flagged``; rows to impute get column means."""
    means = df.agg(*[F.avg(c).alias(c) for c in impute]).first() if impute else {}
    by_key = fixes.groupBy(F.col("key").alias("__key")).agg(F.max_by(F.when(F.col("action") == "relabel", F.col("value")), F.when(F.col("action") == "relabel", F.col("confidence"))).alias("__label"), F.max(F.col("action") == "remove").alias("__gone"), F.max(F.col("action") == "flag").alias("__flag"), F.max(F.col("action") == "impute").alias("__impute"))
    joined = df.join(by_key, df[key] == F.col("__key"), "left").where(~F.coalesce("__gone", F.lit(False)))
    out = []
    for c in df.columns:
        if c == label:
            out.append(F.coalesce(F.col("__label").cast(df.schema[c].dataType), F.col(c)).alias(c))
        elif c in impute:
            out.append(F.when(F.coalesce("__impute", F.lit(False)) & F.col(c).isNotNull(), F.lit(means[c])).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out, F.coalesce("__flag", F.lit(False)).alias("is_flagged"))


def without(df: DataFrame, key: str, *issues: DataFrame) -> DataFrame:
    """The table without the keys of any of the issue tables (column ``key``)."""
    keys = reduce(DataFrame.union, [i.select("key") for i in issues]).distinct()
    return df.join(keys, df[key] == keys["key"], "left_anti")


def issue_keys(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [i.select("key") for i in issues]).distinct()


def gravest_outliers(outliers: DataFrame, share: float = 0.75) -> DataFrame:
    """Outliers whose score reaches that quantile of scores."""
    cut = quantiles(outliers, ["score"], [share])["score"][0]
    return outliers.where(F.col("score") >= F.lit(cut))


def review_queue(labels: DataFrame, outliers: DataFrame, duplicates: DataFrame | None = None, most: int = 100) -> DataFrame:
    """type, key, priority of the issues to look at first: label errors by confidence, outliers at half their score, near pairs at .3 of similarity."""
    parts = [labels.select(F.lit("label_error").alias("type"), "key", F.col("confidence").alias("priority")), outliers.select(F.lit("outlier").alias("type"), "key", (0.5 * F.col("score")).alias("priority"))]
    if duplicates is not None:
        parts.append(duplicates.where("not is_exact").select(F.lit("near_duplicate").alias("type"), F.col("key2").alias("key"), (0.3 * F.col("similarity")).alias("priority")))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("priority"), "type", "key").limit(most)


def page(df: DataFrame, order: list[Column | str], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a totally ordered table: what lies before and on it is kept by each task, no more."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def curation_plan(df: DataFrame, key: str, numbers: list[str], label: str | None = None) -> DataFrame:
    """action, column, rows, confidence: removal of repeats, of values beyond 3 IQRs (if under 5 % of rows), imputation (if under 30 % missing), labels to fill in."""
    n = df.count()
    others = [c for c in df.columns if c != key]
    parts = [df.groupBy(*others).count().agg(F.sum(F.col("count") - 1).alias("rows")).select(F.lit("remove_duplicates").alias("action"), F.lit(None).cast("string").alias("column"), "rows", F.lit(0.95).alias("confidence")).where("rows > 0")]
    q = quantiles(df, numbers, [0.25, 0.75]) if numbers else {}
    counts = []
    for c in numbers:
        q1, q3 = q[c]
        if q1 is not None and q3 > q1:
            far = (F.col(c) < q1 - 3 * (q3 - q1)) | (F.col(c) > q3 + 3 * (q3 - q1))
            counts.append(F.struct(F.lit("remove_outliers").alias("action"), F.lit(c).alias("column"), F.count_if(far).alias("rows"), F.lit(0.75).alias("confidence"), F.lit(0.05 * n).alias("most")))
    for c in others:
        if c != label:
            counts.append(F.struct(F.lit("impute").alias("action"), F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("rows"), F.lit(0.7).alias("confidence"), F.lit(0.3 * n).alias("most")))
    if label:
        counts.append(F.struct(F.lit("label_missing").alias("action"), F.lit(label).alias("column"), F.count_if(F.col(label).isNull()).alias("rows"), F.lit(0.8).alias("confidence"), F.lit(float(n + 1)).alias("most")))
    if counts:
        parts.append(df.agg(F.array(*counts).alias("all")).select(F.inline("all")).where("rows > 0 and rows < most").drop("most"))
    return reduce(DataFrame.unionByName, parts)


def carry_out(df: DataFrame, plan: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """The table after a plan's actions of confidence ``least`` or more, in the plan's own order of kinds: repeats, outliers, imputation.

    Of repeated rows the least key stays; values beyond 3 IQRs take their rows
    with them; missing numbers become the mean, other missing values the mode,
    of what is left then. Missing labels are for people to fill in and stay. A
    plan has a row for each action and column, so it is read to the driver.
    """
    from .duplicates import first_of_each
    from .tabular import fill_missing

    actions = [(r["action"], r["column"]) for r in plan.where(F.col("confidence") >= least).collect()]
    others = [c for c in df.columns if c != key]
    out = first_of_each(df, key, others) if any(a == "remove_duplicates" for a, _ in actions) else df
    far = [c for a, c in actions if a == "remove_outliers"]
    for c, (q1, q3) in (quantiles(df, far, [0.25, 0.75]) if far else {}).items():
        out = out.where(F.coalesce(F.col(c).between(q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)), F.lit(True)))
    missing = [c for a, c in actions if a == "impute"]
    numbers = [c for c in missing if c in numeric_columns(df)]
    if numbers:
        out = fill_missing(out, numbers, "mean")
    if rest := [c for c in missing if c not in numbers]:
        out = fill_missing(out, rest, "mode")
    return out
