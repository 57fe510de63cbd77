"""Whole analyses, plug-ins, votes, cleaning, interpolation, drawn categories and the predictor on small tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievestone.functions.working import written
from sievestone.operators import annotators, predictor, synthetic, texts
from sievestone.plans import registry
from sievestone.plans.analysis import analyze, auto_analyze
from sievestone.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 10), float(i // 10), "a" if i % 3 else "b") for i in range(60)] + [(60, 500.0, 1.0, "a"), (61, 3.0, 2.0, None), (62, 3.0, 2.0, "a"), (63, 3.0001, 2.0, "a")]
    return spark.createDataFrame(data, "k long, x double, y double, target string")


def test_scores_by_class_and_feature(spark, rows):
    given = rows.where("target is not null").select("k", F.when(F.col("k").isin(4, 5), F.array(F.lit(0.1), F.lit(0.9))).otherwise(F.when(F.col("target") == "a", F.array(F.lit(0.8), F.lit(0.2))).otherwise(F.array(F.lit(0.2), F.lit(0.8)))).alias("probs"))
    found = analyze(rows, "k", "target", probabilities=given, near=0.99999)
    classes = {r["class"]: (r["rows"], r.errors, r.score) for r in found.per_class().collect()}
    assert classes == {"a": (43, 2, 75.0), "b": (20, 0, 100.0)}
    features = {r.feature: r.outliers for r in found.per_feature().collect()}
    assert features == {"x": 1, "y": 0}
    near = {(r.key1, r.key2) for r in found.issues["near_duplicates"].collect()}
    assert (23, 63) in near and not any(62 in p or 61 in p for p in near)  # copies of row 23 are duplicates already
    advice = found.advice().collect()
    assert [r.kind for r in advice][0] == "near_duplicates" or advice[0].share >= advice[-1].share
    assert {r.kind: r.n for r in advice}["duplicates"] == 2
    assert analyze(rows, "k", "target", label_errors=False).per_class().where("score < 100").count() == 0
    with pytest.raises(ValueError):
        analyze(rows, "k").per_class()


def test_automatic_analysis(spark, rows):
    found, guess = auto_analyze(rows, "k", label_errors=False)
    assert guess["label"] == "target" and "imbalance" in found.issues and found.score().first().n_samples == 64
    numeric = spark.createDataFrame([(i, i * 1.5, float(i)) for i in range(150)], "k long, target double, x double")
    found, guess = auto_analyze(numeric, "k")
    assert guess["task"] == "regression" and found.data.features == ["x"] and "imbalance" not in found.issues


def test_plug_ins_take_part(spark, rows, tmp_path):
    registry.register("metric", "top")(lambda df: F.max("x"))
    registry.register("evaluator", "small")(lambda df: (F.col("x") < 5).cast("double"))
    registry.register("evaluator", "even")(lambda df: F.when(F.col("k") > 1, (F.col("k") % 2 == 0).cast("double")))
    registry.register("operation", "shift")(lambda df, by: df.withColumn("x", F.col("x") + by))
    registry.register("fixer", "first")(lambda df, n: df.where(F.col("k") < n))
    registry.register("rule", "few")(lambda row: "Gather more rows." if row["n_samples"] < 100 else None)
    registry.register("detector", "big")(lambda df, key, columns: df.where(F.col("x") > 400).select(F.col(key).alias("key")))
    registry.register("exporter", "lines")(lambda df, path, mode: df.select(F.to_csv(F.struct("*"))).write.mode(mode).text(path))
    registry.register("loader", "lines")(lambda spark, path, schema: spark.read.text(path).select(F.from_csv("value", schema).alias("r")).select("r.*"))
    try:
        assert registry.measured(rows, "top").first()["top"] == 500.0
        scored = {r.k: r.overall for r in registry.evaluated(rows, {"small": 3.0, "even": 1.0}).collect()}
        assert scored[0] == 1.0 and scored[2] == 1.0 and scored[3] == 0.75 and scored[8] == 0.25
        assert registry.operated(rows, ("shift", {"by": 1.0}), ("first", {"n": 2})).agg(F.sum("x")).first()[0] == 3.0
        found = analyze(rows, "k", label_errors=False)
        assert "Gather more rows." in found.recommendations() and found.issues["big"].count() == 1
        tables.write_any(rows.select("k", "x"), str(tmp_path / "x.lines"), "lines")
        assert tables.read_any(spark, str(tmp_path / "x.lines"), "k long, x double").agg(F.sum("x")).first()[0] == rows.agg(F.sum("x")).first()[0]
    finally:
        for kind, name in (("metric", "top"), ("evaluator", "small"), ("evaluator", "even"), ("operation", "shift"), ("fixer", "first"), ("rule", "few"), ("detector", "big"), ("exporter", "lines"), ("loader", "lines")):
            registry.forget(kind, name)


def test_votes_are_resolved(spark):
    votes = [(1, "a", 1.0, 0.9, "member"), (1, "b", 3.0, 0.5, "member"), (1, "a", None, 0.2, "expert"), (2, "a", 1.0, 1.0, "member"), (2, "b", 1.0, 1.0, "member"), (3, "b", 1.0, 1.0, None), (3, "b", 1.0, 1.0, None), (3, None, 9.0, 1.0, "expert")]
    a = spark.createDataFrame(votes, "sample_id int, label string, weight double, confidence double, role string")
    got = {s: {r.sample_id: (r.label, round(r.support, 4), r.by) for r in annotators.resolved(a, s).collect()} for s in ("majority", "weighted", "expert", "consensus")}
    assert got["majority"] == {1: ("a", 0.6667, "all"), 2: (None, 0.5, "all"), 3: ("b", 1.0, "all")}
    assert got["weighted"][1] == ("b", round(1.5 / 2.6, 4), "all") and got["expert"][1] == ("a", 1.0, "experts") and got["expert"][3][2] == "all"
    assert {k: v[0] for k, v in got["consensus"].items()} == {1: None, 2: None, 3: "b"}


def test_pairs_and_passages_are_cleaned(spark):
    df = spark.createDataFrame([(1, "Say it", "A fine long answer."), (2, "Say it", "Another fine answer."), (3, "x", "short"), (4, None, None), (5, "What?", "I cannot help with that, sorry.")], "k long, instruction string, response string")
    issues = texts.instruction_issues(df, "k")
    found = Counter((r.k, r.issue) for r in issues.collect())
    assert found[2, "duplicate"] and found[3, "too_short"] and found[4, "too_short"] and not found[1, "duplicate"]
    assert sorted(r.k for r in texts.cleaned(df, "k", issues).collect()) == [1, 5]
    assert sorted(r.k for r in texts.cleaned(df, "k", issues, ()).collect()) == [1, 2, 3, 4, 5]
    one = texts.issue_summary(df, issues).first()
    assert one.n_samples == 5 and one.duplicate_rate == 0.2 and one.short_rate == 0.4
    docs = df.select("k", F.col("response").alias("text")).unionByName(df.select(F.col("k") + 10, "response").toDF("k", "text"))
    assert sorted(r.k for r in texts.cleaned(docs, "k", texts.passage_issues(docs, "k")).collect()) == [1, 2, 5]
    assert texts.instruction_issues(df, "k", kinds=("format",)).count() == 0


def test_points_between_rows(spark):
    df = spark.createDataFrame([(i, "few" if i < 4 else "many" if i < 100 else "one", float(i), None if i == 2 else float(i * 2)) for i in range(101)], "k long, c string, x double, y double")
    plan = spark.createDataFrame([("few", 4, 17), ("many", 96, 96), ("one", 1, 5)], "label string, count long, target long")
    got = synthetic.interpolated(df, "k", "c", ["x", "y"], plan).collect()
    assert len(got) == 13 and {r.c for r in got} == {"few"}
    for r in got:
        assert r.source != r.partner and min(r.source, r.partner) < r.x < max(r.source, r.partner)
        share = (r.x - r.source) / (r.partner - r.source)
        assert 0.2 <= share <= 0.8 and (r.y is None) == (2 in (r.source, r.partner))
    assert max(Counter((r.source, r.partner) for r in got).values()) <= 2


def test_categories_are_drawn_by_frequency(spark):
    real = spark.range(1000).select(F.when(F.col("id") < 600, "a").when(F.col("id") < 900, "b").otherwise(None).alias("c"))
    got = Counter(r.c for r in synthetic.drawn_categories(real, "c", spark.range(5000), "id").collect())
    assert sum(got.values()) == 5000 and abs(got["a"] - 3000) < 150 and abs(got["b"] - 1500) < 150 and abs(got[None] - 500) < 100


def test_quality_is_foretold_better_than_by_the_mean(spark):
    o = spark.range(400).select("id", (F.col("id") % 3).alias("c"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("y"))
    rows = predictor.bootstrap_tables(o, "id", 150, spoil={"x": F.col("x") * 50, "y": F.lit(None).cast("double")}, most=0.8)
    numbers = written(predictor.table_numbers(rows, "c", ["x", "y"], {"x": (0.0, 100.0)}))
    assert numbers.count() == 150 and numbers.where("quality is null").count() == 0
    own = predictor.learn(numbers, trees=8)
    assert own.error < 0.7 * own.mean_error
    told = own.predict(numbers).join(numbers.select("table", "quality"), "table").collect()
    inside = sum(r.low - 1e-9 <= r.quality <= r.high + 1e-9 for r in told) / len(told)
    assert inside >= 0.85 and all(0 <= r.low <= r.predicted <= r.high <= 100 for r in told)
