"""Label errors, class balance, group bias."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import numeric_columns, ratio, string_columns, zero_filled

#: Parts of column names that mark a sensitive feature.
SENSITIVE = ("gender", "sex", "age", "race", "ethnicity", "religion", "disability", "marital", "nationality", "country", "region")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """label, count, ratio of every class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("n")))).select("label", "count", (F.col("count") / F.col("n")).alias("ratio"))


def class_summary(df: DataFrame, label: str) -> DataFrame:
    """One row: classes, majority and minority (ties to the smaller label), their ratio."""
    d = class_distribution(df, label)
    return d.agg(F.count("*").alias("classes"), F.min(F.struct(-F.col("count"), "label"))["label"].alias("majority"), F.min(F.struct("count", "label"))["label"].alias("minority"), (F.max("count") / F.min("count")).alias("imbalance_ratio"))


def imbalance(df: DataFrame, label: str, threshold: float = 5.0) -> DataFrame:
    """type, class, ratio, count, severity: a severe ratio, minority classes under 5 %, classes under 10 rows."""
    d = class_distribution(df, label)
    s = class_summary(df, label)
    severe = s.where(F.col("imbalance_ratio") >= threshold).select(F.lit("severe_imbalance").alias("type"), F.col("minority").cast("string").alias("class"), F.col("imbalance_ratio").alias("ratio"), F.lit(None).cast("long").alias("count"), F.when(F.col("imbalance_ratio") >= 10, "high").otherwise("medium").alias("severity"))
    small = d.where("ratio < 0.05").select(F.lit("minority_class"), F.col("label").cast("string"), "ratio", "count", F.when(F.col("ratio") < 0.01, "high").otherwise("medium"))
    few = d.where("count < 10").select(F.lit("insufficient_samples"), F.col("label").cast("string"), "ratio", "count", F.lit("high"))
    return severe.union(small).union(few)


def resampling(df: DataFrame, label: str) -> DataFrame:
    """label, count, weight (largest class / own), strategy by the ratio of the table."""
    d = class_distribution(df, label)
    top = d.agg(F.max("count").alias("most"), F.min("count").alias("fewest"))
    r = F.col("most") / F.col("fewest")
    return d.crossJoin(F.broadcast(top)).select("label", "count", (F.col("most") / F.col("count")).alias("weight"), F.when(r >= 10, "smote_and_class_weights").when(r >= 5, "random_oversample").otherwise("none").alias("strategy"))


def sensitive_features(df: DataFrame, most: int = 5, few: int = 10) -> list[str]:
    """Columns with a sensitive name, or text columns of fewer than ``few`` values; the first five."""
    texts = [c for c in string_columns(df) if not any(k in c.lower() for k in SENSITIVE)]
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in texts]).first() if texts else {}
    return [c for c in df.columns if any(k in c.lower() for k in SENSITIVE) or c in texts and counts[c] < few][:most]


def group_rates(df: DataFrame, feature: str, label: str) -> DataFrame:
    """group, size, share, positive_rate of every group."""
    g = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).alias("group")).agg(F.count("*").alias("size"), F.avg(F.col(label).cast("double")).alias("positive_rate"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("size").alias("n")))).select("group", "size", (F.col("size") / F.col("n")).alias("share"), "positive_rate")


def demographic_parity(df: DataFrame, feature: str, label: str, threshold: float = 0.1) -> DataFrame:
    """One row: the gap between the largest and the smallest positive rate, and whether it exceeds the threshold."""
    return group_rates(df, feature, label).agg(F.lit(feature).alias("feature"), (F.max("positive_rate") - F.min("positive_rate")).alias("value"), F.lit(threshold).alias("threshold"), ((F.max("positive_rate") - F.min("positive_rate")) > threshold).alias("is_biased"))


def under_represented(df: DataFrame, feature: str, label: str, least: float = 0.01) -> DataFrame:
    return group_rates(df, feature, label).where(F.col("share") < least).select("group", "size", "share")


def label_correlation(df: DataFrame, features: list[str], label: str, threshold: float = 0.3) -> DataFrame:
    """feature, correlation, is_biased of numeric features with a numeric label."""
    one = [F.struct(F.lit(f).alias("feature"), F.corr(zero_filled(f), F.col(label).cast("double")).alias("correlation")) for f in features if f in numeric_columns(df)]
    return df.agg(F.array(*one).alias("all")).select(F.inline("all")).withColumn("is_biased", F.coalesce(F.abs("correlation") > threshold, F.lit(False)))


def equalized_odds(df: DataFrame, feature: str, label: str, prediction: str) -> DataFrame:
    """group, tpr, fpr; 0 where a group has no positives or negatives."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(F.col(feature).alias("group")).agg(ratio(F.count_if(y & p), F.count_if(y)).alias("tpr"), ratio(F.count_if(~y & p), F.count_if(~y)).alias("fpr"))


def self_confidence_errors(df: DataFrame, key: str, label: str, probs: str, threshold: float = 0.5) -> DataFrame:
    """key, given, predicted, confidence: p(given) < 1 - threshold, largest p > threshold, another class likeliest.

    ``label`` is the class number from 0 and ``probs`` an array of class probabilities.
    """
    own = F.element_at(probs, (F.col(label) + 1).cast("int"))
    best = F.array_max(probs)
    guess = (F.array_position(probs, best) - 1).cast("int")
    return df.select(key, F.col(label).alias("given"), guess.alias("predicted"), own.alias("self_confidence"), best.alias("confidence")).where((F.col("self_confidence") < 1 - threshold) & (F.col("confidence") > threshold) & (F.col("predicted") != F.col("given")))


def confident_joint(df: DataFrame, label: str, probs: str) -> DataFrame:
    """given, predicted, count: rows confidently counted into classes whose probability reaches the class's own mean (Northcutt, Jiang and Chuang 2021)."""
    means = df.groupBy(F.col(label).alias("c")).agg(F.avg(F.element_at(probs, (F.col(label) + 1).cast("int"))).alias("t"))
    limits = F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int"), "t")))
    rows = df.select(label, probs).crossJoin(F.broadcast(means.agg(limits.alias("limits"))))
    over = F.filter(F.transform(probs, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"), (p >= F.element_at("limits", i)).alias("ok"))), lambda x: x["ok"])
    best = rows.select(F.col(label).cast("int").alias("given"), F.array_max(over).alias("best")).where("best is not null")
    return best.groupBy("given", (-F.col("best.i")).cast("int").alias("predicted")).agg(F.count("*").alias("count"))


def confident_errors(df: DataFrame, key: str, label: str, probs: str) -> DataFrame:
    """key, given, predicted, self_confidence of rows off the diagonal of the confident joint, as likely errors."""
    means = df.groupBy(F.col(label).alias("c")).agg(F.avg(F.element_at(probs, (F.col(label) + 1).cast("int"))).alias("t"))
    limits = F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int"), "t")))
    rows = df.select(key, label, probs).crossJoin(F.broadcast(means.agg(limits.alias("limits"))))
    over = F.filter(F.transform(probs, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"), (p >= F.element_at("limits", i)).alias("ok"))), lambda x: x["ok"])
    out = rows.select(key, F.col(label).cast("int").alias("given"), (-F.array_max(over)["i"]).cast("int").alias("predicted"), F.element_at(probs, (F.col(label) + 1).cast("int")).alias("self_confidence"))
    return out.where("predicted is not null and predicted <> given")


def errors_by_language(df: DataFrame, key: str, label: str, probs: str, lang: str, least: int = 10) -> DataFrame:
    """key, lang, given, predicted, self_confidence: likely label errors, each language judged by its own classes' mean probabilities.

    Languages of fewer than ``least`` rows are left out, and rows without one.
    """
    rows = df.where(F.col(lang).isNotNull()).select(key, F.col(lang).alias("lang"), F.col(label).cast("int").alias("given"), F.col(probs).alias("probs"))
    means = rows.groupBy("lang", "given").agg(F.count("*").alias("n"), F.avg(F.element_at("probs", F.col("given") + 1)).alias("t"))
    limits = means.groupBy("lang").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("given", "t"))).alias("limits")).where(F.col("n") >= least)
    over = F.filter(F.transform("probs", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"), (p >= F.element_at("limits", i)).alias("ok"))), lambda x: x["ok"])
    out = rows.join(limits.drop("n"), "lang").select(key, "lang", "given", (-F.array_max(over)["i"]).cast("int").alias("predicted"), F.element_at("probs", F.col("given") + 1).alias("self_confidence"))
    return out.where("predicted is not null and predicted <> given")


def out_of_fold_probabilities(df: DataFrame, key: str, label: str, columns: list[str], folds: int = 5, rounds: int = 50) -> DataFrame:
    """key, label, probs: each row's class probabilities from a logistic regression that has not seen its fold.

    ``columns`` are numbers or arrays of numbers; arrays count with all their
    components, null, missing and NaN ones as 0.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    arrays = [c for c in columns if isinstance(df.schema[c].dataType, T.ArrayType)]
    sizes = df.agg(*[F.max(F.size(c)).alias(c) for c in arrays]).first() if arrays else None

    def feature(c: str):
        if c not in arrays:
            return zero_filled(c)
        values = F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>"))
        places = F.sequence(F.lit(0), F.lit(max(1, sizes[c] or 0) - 1))
        return array_to_vector(F.transform(places, lambda i: F.coalesce(F.nanvl(F.get(values, i), F.lit(0.0)), F.lit(0.0))))

    names = [f"f{i}" for i in range(len(columns))]  # names of our own: the table's may be any
    filled = df.select(F.col(key).alias("row_key"), F.col(label).cast("double").alias("row_label"), *[feature(c).alias(n) for c, n in zip(columns, names, strict=True)]).withColumn("fold", F.pmod(F.xxhash64("row_key"), F.lit(folds)))
    rows = VectorAssembler(inputCols=names, outputCol="raw").transform(filled)
    out = None
    for k in range(folds):
        train, held = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
        model = LogisticRegression(featuresCol="x", labelCol="row_label", maxIter=rounds).fit(scaler.transform(train))
        part = model.transform(scaler.transform(held)).select(F.col("row_key").alias(key), F.col("row_label").cast("int").alias(label), vector_to_array("probability").alias("probs"))
        out = part if out is None else out.unionByName(part)
    return out
