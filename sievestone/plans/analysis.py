"""The whole analysis of a table as lazy results, and documents made from them."""

from __future__ import annotations

from dataclasses import dataclass, field
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import numeric_columns, ratio, string_columns
from ..operators import duplicates, labels, outliers, scores, tabular
from ..operators.graph import FACTORS
from ..sources.tables import Dataset, load
from . import registry

#: What it costs to mend an issue, by kind.
UNIT_COST = {"label_errors": 0.35, "outliers": 0.05, "duplicates": 0.0, "near_duplicates": 0.05, "imbalance": 0.0, "bias": 0.25}
#: The factor of the issue graph that a kind's gain comes from, and what to do about a kind.
GAIN_OF = {"label_errors": "label_error", "duplicates": "duplicate", "near_duplicates": "duplicate", "outliers": "outlier"}
ACTIONS = {
    "label_errors": "Review the labels that the model disputes, most confident first.", "duplicates": "Remove repeated rows before splitting the data.", "near_duplicates": "Look at near copies and keep one of each.",
    "outliers": "Check the outliers, and mend or flag them.", "imbalance": "Balance the classes by resampling or weights.", "bias": "Check the groups with different label rates.",
}


@dataclass
class Analysis:
    """Issue tables of one dataset by kind. ``failed`` tells which detectors could not be planned, and why."""

    data: Dataset
    issues: dict[str, DataFrame] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def counts(self) -> DataFrame:
        """One row: n_samples and the number of issues of each kind, in one job."""
        out = self.data.data.agg(F.count("*").alias("n_samples"))
        for kind, df in self.issues.items():
            out = out.crossJoin(df.agg(F.count("*").alias(f"n_{kind}")))
        return out

    def score(self) -> DataFrame:
        """One row: counts, component scores, overall score and severity; what was not looked for scores 100."""
        c = self.counts()
        n = F.col("n_samples")
        have = lambda k: F.col(f"n_{k}") if k in self.issues else F.lit(0)
        if self.data.label:
            c = c.crossJoin(labels.class_summary(self.data.data, self.data.label).select("imbalance_ratio"))
        ratio_score = scores.imbalance_score(F.col("imbalance_ratio")) if self.data.label else F.lit(100.0)
        parts = {"label": scores.label_score(have("label_errors"), n), "duplicate": scores.duplicate_score(have("duplicates") + have("near_duplicates"), have("duplicates"), n), "outlier": scores.outlier_score(have("outliers"), n), "imbalance": ratio_score, "bias": scores.bias_score(have("bias"), F.lit(0.0))}
        rows = c.select("*", *[v.alias(f"{k}_score") for k, v in parts.items()])
        total = scores.overall({k: F.col(f"{k}_score") for k in parts})
        return rows.withColumn("overall", total).withColumn("severity", scores.severity(F.col("overall")))

    def recommendations(self) -> list[str]:
        row = self.score().first().asDict()
        n = max(1, row["n_samples"])
        texts = [
            (row.get("n_label_errors", 0) / n > 0.05, "Review labels: over 5 % look wrong."),
            (row.get("n_duplicates", 0) / n > 0.01, "Remove repeated rows before splitting the data."),
            (row.get("n_outliers", 0) / n > 0.1, "Look at the outliers: there are more than expected."),
            (row.get("imbalance_ratio", 1) >= 5, "Balance the classes by resampling or weights."),
            (row.get("n_bias", 0) > 0, "Check the groups with different label rates."),
        ]
        ruled = [text for name in registry.names("rule") if (text := registry.get("rule", name)(row))]
        return [t for test, t in texts if test] + ruled

    def per_class(self) -> DataFrame:
        """class, rows, errors, score: each class's rows with a disputed label, scored as the whole table's labels are; null labels are no class."""
        if not self.data.label:
            raise ValueError("scores of classes need a label")
        rows = self.data.data.where(F.col(self.data.label).isNotNull()).groupBy(F.col(self.data.label).alias("class")).agg(F.count("*").alias("rows"))
        if "label_errors" not in self.issues:
            return rows.select("class", "rows", F.lit(0).cast("long").alias("errors"), F.lit(100.0).alias("score"))
        codes = tabular.label_codes(self.data.data, self.data.label).select(F.col(self.data.label).alias("own_class"), "code")  # a row for each class
        wrong = self.issues["label_errors"].groupBy(F.col("given").alias("code")).agg(F.count("*").alias("errors")).join(codes, "code").select("own_class", "errors")
        both = rows.join(wrong, F.col("class") == F.col("own_class"), "left").select("class", "rows", F.coalesce("errors", F.lit(0)).alias("errors"))
        return both.withColumn("score", scores.label_score(F.col("errors"), F.col("rows")).cast("double"))

    def per_feature(self) -> DataFrame:
        """feature, outliers, score: the outliers that each feature has a part in, scored as the whole table's are."""
        n = self.data.data.agg(F.count("*").alias("n"))
        features = self.data.data.sparkSession.createDataFrame([(c,) for c in self.data.features], "feature string")
        if "outliers" in self.issues:
            found = self.issues["outliers"].select(F.explode(F.split("features", ",")).alias("own")).groupBy("own").agg(F.count("*").alias("k"))
        else:
            found = features.select(F.col("feature").alias("own"), F.lit(0).alias("k"))
        both = features.join(found, F.col("feature") == F.col("own"), "left").crossJoin(n)  # one row of counts
        both = both.select("feature", F.coalesce("k", F.lit(0)).cast("long").alias("outliers"), "n")
        return both.select("feature", "outliers", scores.outlier_score(F.col("outliers"), F.col("n")).cast("double").alias("score"))

    def advice(self, value: float = 1000.0) -> DataFrame:
        """kind, n, share, priority, cost, gain, roi, action of the kinds of issues found, most urgent first.

        Cost is that of mending them all; the gain of accuracy is a factor an
        issue, 0.15 at most; roi is the gain at ``value`` over the cost, null
        without cost. The priority is critical over a tenth of the rows, high
        over a twentieth, medium over a hundredth.
        """
        counts = self.counts()
        cells = [F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"), F.lit(float(UNIT_COST.get(k, 0.0))).alias("unit"), F.lit(float(FACTORS[GAIN_OF[k]]["accuracy"] if k in GAIN_OF else 0.0)).alias("factor"), F.lit(ACTIONS.get(k, "")).alias("action")) for k in self.issues]
        rows = counts.select("n_samples", F.inline(F.array(*cells))).where("n > 0")
        share, cost, gain = ratio(F.col("n"), F.col("n_samples")), F.col("n") * F.col("unit"), F.least(F.lit(0.15), F.col("n") * F.col("factor") * 0.5)
        rank = F.when(F.col("share") > 0.1, 0).when(F.col("share") > 0.05, 1).when(F.col("share") > 0.01, 2).otherwise(3)
        out = rows.select("kind", "n", share.alias("share"), cost.alias("cost"), gain.alias("gain"), F.when(cost > 0, gain * value / cost).alias("roi"), "action").withColumn("rank", rank)
        names = F.array(*map(F.lit, ("critical", "high", "medium", "low")))
        return out.orderBy("rank", F.desc("share"), "kind").select("kind", "n", "share", F.element_at(names, F.col("rank") + 1).alias("priority"), "cost", "gain", "roi", "action")

    def to_json(self) -> DataFrame:
        return self.score().select(F.to_json(F.struct("*")).alias("value"))

    def to_html(self) -> str:
        row = self.score().first().asDict()
        cells = "".join(f"<tr><th>{escape(str(k))}</th><td>{escape(str(v))}</td></tr>" for k, v in row.items())
        tips = "".join(f"<li>{escape(t)}</li>" for t in self.recommendations())
        return f"<html><body><table>{cells}</table><ul>{tips}</ul></body></html>"

    def summary(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in self.score().first().asDict().items())


def analyze(df: DataFrame, key: str, label: str | None = None, features: list[str] | None = None, exclude: list[str] | None = None, outlier_method: str = "iqr", probabilities: DataFrame | None = None, label_errors: bool = True, near: float | None = None, near_copies: bool = False) -> Analysis:
    """Detect label, duplicate, outlier, imbalance and bias issues; failures are told and not hidden.

    With ``near``, pairs of different rows whose numbers, brought to 0..1, have
    a cosine of that or more are near duplicates; copies of a row are not
    listed again, but with ``near_copies``: then all pairs of rows are, copies
    of a row among them.

    Label errors are those of the confident joint over ``probabilities`` (the
    key and ``probs``, an array in the sorted order of the labels), or, without
    them and unless ``label_errors`` is false, over out-of-fold probabilities of
    a logistic regression on the numeric features, which is fitted here; all
    else stays lazy.
    """
    data = load(df, label, features, exclude, key)
    out = Analysis(data)
    numbers = [c for c in numeric_columns(data.data, (key, label)) if c in data.features]

    def detect(kind, make):
        try:
            out.issues[kind] = make()
        except Exception as e:  # a detector that can't be planned for this table is reported
            out.failed[kind] = f"{type(e).__name__}: {e}"

    detect("duplicates", lambda: duplicates.pointers(data.data, key, data.features))
    if near is not None and numbers:
        each = data.data if near_copies else duplicates.first_of_each(data.data, key, data.features)
        units = lambda: duplicates.unit_vectors(each, key, numbers).withColumn("v", F.concat("v", F.array((F.lit(near_copies) & ~F.exists("v", lambda x: x != 0)).cast("double"))))  # noqa: E731  # copies of zeros are like each other alone
        detect("near_duplicates", lambda: duplicates.near_pairs(units(), key, near))
    for name in registry.names("detector"):
        detect(name, lambda name=name: registry.get("detector", name)(data.data, key, numbers))
    if numbers:
        detect("outliers", lambda: getattr(outliers, outlier_method)(data.data, key, numbers))
    if label and (probabilities is not None or (label_errors and numbers)):
        coded = tabular.encode(data.data.where(F.col(label).isNotNull()), label, "class_code")
        fit = lambda: labels.out_of_fold_probabilities(coded, key, "class_code", numbers) if probabilities is None else coded.select(key, "class_code").join(probabilities.select(key, "probs"), key)
        detect("label_errors", lambda: labels.confident_errors(fit(), key, "class_code", "probs"))
    if label:
        detect("imbalance", lambda: labels.imbalance(data.data, label))
        if label in numeric_columns(df):
            for f in labels.sensitive_features(data.data.select(*data.features)):
                if f in string_columns(df):
                    detect("bias", lambda f=f: labels.demographic_parity(data.data, f, label).where("is_biased"))
    return out


def auto_detect(df: DataFrame) -> dict[str, str | None]:
    """Label column and task of a table by names and values: .5 for the name, .3 for few values, .2 for two, .1 for few among many rows."""
    import re

    names = r"^(label|target|class|y|category|outcome|result|response|output|prediction|ground_truth|is_.*|has_.*)$"
    p = {r["column"]: r for r in tabular.profile(df).collect()}
    best, kind = (0.3, None), None
    for c, r in p.items():
        few = r["distinct"] < 20
        s = 0.5 * bool(re.match(names, c.lower())) + 0.3 * (few and c in string_columns(df)) + 0.2 * (r["distinct"] == 2) + 0.1 * (few and r["rows"] > 100)
        if s > best[0]:
            best = (s, c)
    if best[1]:
        kind = "regression" if dict(df.dtypes)[best[1]] in ("double", "float") and p[best[1]]["distinct"] > 20 else "classification"
    return {"label": best[1], "task": kind}


def auto_analyze(df: DataFrame, key: str, label: str | None = None, **options) -> tuple[Analysis, dict[str, str | None]]:
    """``analyze`` with the label that ``auto_detect`` finds, if none is given, and what was found. Labels of a regression are not judged as classes."""
    found = auto_detect(df.drop(key))
    label = label or found["label"]
    regression = label is not None and label == found["label"] and found["task"] == "regression"
    return analyze(df, key, None if regression else label, exclude=[label] if regression else None, **options), found
