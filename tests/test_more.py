"""Ranges, row texts, checks, similarity across tables, drift of batches, label errors in the analysis, curation."""

import random

import pytest
from pyspark.sql import functions as F

from sievestone.functions import ranges
from sievestone.operators import checks, drift, duplicates, history, labels, outliers, privacy, repairs, synthetic, tabular, texts, vectors
from sievestone.plans import registry
from sievestone.plans.analysis import analyze


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 7)  # many ranges even for small tables


def series(spark):
    rng = random.Random(3)
    rows = [(i, "a" if i % 3 else None, i * 2 if i % 4 else None, rng.random() < 0.4) for i in range(60)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "t long, g string, v long, flag boolean").withColumn("range", F.lit("clash"))


def test_ranks_and_sums_over_ranges(spark, narrow):
    rows, df = series(spark)
    got = ranges.ranked(df, ["g"], "t", "place", {"total": F.col("v")})
    assert got.columns == ["t", "g", "v", "flag", "range", "place", "total"]
    want = {}
    for g in ("a", None):
        total = 0
        for k, r in enumerate(sorted(x for x in rows if x[1] == g), 1):
            total += r[2] or 0
            want[r[0]] = (k, total)
    assert {r.t: (r.place, r.total) for r in got.collect()} == want


@pytest.mark.parametrize("backward", [False, True])
def test_values_are_carried_over_ranges(spark, narrow, backward):
    rows, df = series(spark)
    sparse = df.withColumn("v", F.when(F.col("t") % 19 == 5, F.col("v")))
    want = {}
    for g in ("a", None):
        last = None
        for r in sorted((x for x in rows if x[1] == g), reverse=backward):
            last = r[2] if r[0] % 19 == 5 and r[2] is not None else last
            want[r[0]] = last
    assert {r.t: r.v for r in tabular.carry(sparse, "v", "t", ["g"], backward).collect()} == want


def test_rolling_and_steps_over_ranges(spark, narrow):
    rows, df = series(spark)
    want = {}
    for g in ("a", None):
        own = sorted(x for x in rows if x[1] == g)
        for k, r in enumerate(own):
            part = [x[3] for x in own[max(0, k - 9) : k + 1]]
            want[r[0]] = pytest.approx(sum(part) / len(part))
    assert {r.t: r.flag_rate for r in history.rolling(df, ["g"], "t", ["flag"], 10).collect()} == want
    assert history.steps(df, "t", "t").first().asDict() == {"sequential": True, "step": 1}
    assert history.steps(df.where("t <> 30"), "t", "t").first().asDict() == {"sequential": False, "step": 1}
    assert {r.g: r.step for r in history.steps(df.where("g = 'a'"), "t", "t", ["g"]).collect()} == {"a": 1}
    board = history.leaderboard(df.select(F.col("t").cast("string").alias("name"), F.col("v").alias("score")), "name", "score", 3).collect()
    assert [(r["name"], r["rank"]) for r in board] == [("59", 1), ("58", 2), ("57", 3)] and board[0].percentile == pytest.approx(100 * 44 / 60)
    p = history.percentiles(df, "g", "v").where("g = 'a'").first()
    values = sorted(x[2] for x in rows if x[1] == "a" and x[2] is not None)
    at = 0.9 * (len(values) - 1)
    assert p.n == len(values) and p.p90 == pytest.approx(values[int(at)] + (values[int(at) + 1] - values[int(at)]) * (at % 1))


def test_rows_that_differ_are_told_apart(spark):
    rows = [(1, "a|b", "c"), (2, "a", "b|c"), (3, "nan", None), (4, None, "nan"), (5, None, None), (6, None, None), (7, "-", "x"), (8, None, "x")]
    df = spark.createDataFrame(rows, "k long, x string, y string")
    assert [(r.key1, r.key2, r.members) for r in duplicates.exact_pairs(df, "k", ["x", "y"]).collect()] == [(5, 6, 2)]
    assert sorted(r.k for r in duplicates.first_of_each(df, "k", ["x", "y"]).collect()) == [1, 2, 3, 4, 5, 7, 8]
    other = df.where("k in (1, 5, 6)").withColumnRenamed("k", "q")
    assert sorted(map(tuple, duplicates.cross_pairs(df, other, "k", "q", ["x", "y"]).collect())) == [(1, 1, 1, "critical"), (5, 5, 2, "critical"), (6, 5, 2, "critical")]


def test_codes_and_their_labels(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "k long, y string")
    coded = tabular.encode(df, "y")
    assert {r.k: r.code for r in coded.collect()} == {1: 1, 2: None, 3: 0}
    back = tabular.decode(coded.select("k", "code"), tabular.label_codes(df, "y"), "code", "y")
    assert {r.k: r.y for r in back.collect()} == {1: "b", 2: None, 3: "a"}


def test_personal_data_in_any_case(spark):
    # the values are written out here, apart from the operator's own patterns
    text = "mail Joe@Example.ORG or 555-123-4567, ssn 123-45-6789, card 4111 1111 1111 1111, from 10.0.0.1, born 12/31/1999, passport ab1234567, account 12345678"
    df = spark.createDataFrame([(1, text), (2, None)], "k long, t string")
    found = {(r.pii_type, r.value) for r in privacy.scan(df, "k", ["t"]).collect()}
    assert found >= {("email", "Joe@Example.ORG"), ("ssn", "123-45-6789"), ("credit_card", "4111 1111 1111 1111"), ("ip_address", "10.0.0.1"), ("date_of_birth", "12/31/1999"), ("passport", "ab1234567"), ("bank_account", "12345678")}
    assert any(k == "phone" and "555-123-4567" in v for k, v in found)
    red = df.select(privacy.redact(F.col("t")).alias("t")).first().t
    assert "Example" not in red and "ab1234567" not in red and "6789" not in red
    toxic = spark.createDataFrame([("I hate those people",), ("such a stupid idea",), ("a bigot",), ("fine words",)], "t string")
    assert [r.x for r in toxic.select(texts.any_match(F.col("t"), texts.TOXIC).alias("x")).collect()] == [True, True, True, False]


def test_checks_of_inputs(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, None)], "k long, x double, y string")
    assert {r["check"]: (r.value, r.passed) for r in checks.validate(df, ["x"], "y").collect()} == {"rows": (3, True), "features": (1, True), "labels": (2, True), "classes": (2, True)}
    assert checks.require(df, ["x"], "y") is df
    for bad, said in ((df.limit(0), "rows"), (df.where("y = 'a'"), "classes")):
        with pytest.raises(ValueError, match=said):
            checks.require(bad, ["x"], "y")
    with pytest.raises(ValueError, match="features"):
        checks.require(df, [])
    wide = spark.createDataFrame([], "customer_id int, customer_name string, orderId int, order_name string, other_id int")
    assert checks.key_names(wide) == [("customer_id", "customer_name"), ("orderId", "order_name")]
    big = spark.range(1000).withColumnRenamed("id", "k")
    one, two = ({r.k for r in checks.sample_rows(big, "k", 50, seed).collect()} for seed in (1, 1))
    assert one == two and len(one) == 50 and one != {r.k for r in checks.sample_rows(big, "k", 50, 2).collect()}
    assert checks.sample_rows(big.limit(5), "k", 50).count() == 5


def test_gaps_and_plausible_rows(spark):
    rows = [(i, "big", float(i % 7), 1.0) for i in range(60)] + [(100 + i, "small", float(i), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "k long, y string, a double, b double")
    got = [(r.gap, r.label, r.rows, r.target) for r in checks.class_gaps(df, "y", ["a", "b"]).collect()]
    assert got == [("imbalance", "small", 12, 30), ("low_diversity", "big", 60, 90)]
    new = spark.createDataFrame([(1, "small", 6.0, 6.0), (2, "small", 90.0, 6.0), (3, "none", 1.0, 1.0)], df.schema)
    assert [r.k for r in checks.plausible(new, df, "y", ["a", "b"]).collect()] == [1]


def test_matches_across_tables(spark):
    train = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.98, 0.2]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "k long, v array<double>")
    tests = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.7, 0.7]), (3, [0.1, 1.0]), (None, [1.0, 0.0])], "k long, v array<double>")
    got = {r.test_key: (r.matches, round(r.similarity, 4), r.severity) for r in vectors.cross_matches(tests, train, "k", "v", 0.9, block=2).collect()}
    assert got == {1: (2, 1.0, "critical"), 3: (1, 0.995, "critical")}


def test_equal_similarities_go_to_smaller_keys(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in (9, 8, 7, 6, 5, 4, 3)], "k long, v array<double>")
    near = vectors.top_k(df.where("k = 9"), df, "k", "v", 2, block=4).collect()
    assert sorted(r.key for r in near) == [3, 4]


def test_batches_that_drift(spark):
    ref = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50 + [(None,)], "c string")
    new = spark.createDataFrame([(1, "a")] * 30 + [(1, "b")] * 30 + [(2, "a")] * 5 + [(2, "z")] * 45, "day int, c string")
    got = {r.batch: (r.severity, r.alert) for r in drift.monitor(ref, new, "day", ["c"]).collect()}
    assert got == {1: ("none", False), 2: ("critical", True)}


def test_errors_by_language(spark):
    rows = [(i, i % 2, [0.9, 0.1] if i % 2 == 0 else [0.1, 0.9], "en") for i in range(12)] + [(100, 1, [0.95, 0.05], "en"), (101, 1, [0.95, 0.05], "xx"), (102, 1, [0.9, 0.1], None)]
    df = spark.createDataFrame(rows, "k long, y int, p array<double>, lang string")
    assert [(r.k, r.lang, r.given, r.predicted) for r in labels.errors_by_language(df, "k", "y", "p", "lang").collect()] == [(100, "en", 1, 0)]


def test_label_score_follows_planted_noise(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(-2 if i % 2 else 2, 1), rng.gauss(0, 1), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    noisy = synthetic.plant_label_noise(df, "k", "y", 2, 0.15)
    planted = {r.k for r in noisy.where("is_planted").collect()}
    found = analyze(noisy.drop("is_planted"), "k", "y")
    assert not found.failed
    hits = {r.k for r in found.issues["label_errors"].collect()}
    assert len(hits & planted) >= 0.8 * len(planted) and len(hits - planted) <= 0.1 * 300
    scores = [analyze(x, "k", "y").score().first().label_score for x in (df, noisy.drop("is_planted"))]
    assert scores[0] >= 75 and scores[1] <= 60 and scores[0] > scores[1]
    given = df.select("k", F.array(F.lit(0.5), F.lit(0.5)).alias("probs"))
    assert analyze(df, "k", "y", probabilities=given).issues["label_errors"].count() == 150


def test_plans_are_carried_out(spark):
    rows = [(i, float(i % 10), "x" if i % 3 else "y") for i in range(40)] + [(100, 1.0, "x"), (101, None, "x"), (102, 5.0, None), (103, 900.0, "x")]
    df = spark.createDataFrame(rows, "k long, a double, c string")
    done = repairs.carry_out(df, repairs.curation_plan(df, "k", ["a"]), "k")
    left = {r.k: (r.a, r.c) for r in done.collect()}
    assert 103 not in left and 100 not in left and left[102][1] in ("x", "y") and left[101][0] == pytest.approx(sum(a for a, _ in left.values()) / len(left))
    assert all(a is not None and c is not None for a, c in left.values())


def test_presets_set_detectors(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)] + [(99, 9.0)], "k long, x double")
    counts = [registry.detectors(name)["iqr"](df, "k", ["x"]).count() for name in ("high_precision", "high_recall")]
    assert counts == [0, 1] and outliers.zscore(df, "k", ["x"], 2.0).count() == 1
