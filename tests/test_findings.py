"""Findings of reviews: each test fails on the code before its mend."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.functions import ranges
from sievestone.operators import annotators, causes, contamination, outliers, predictor, synthetic, vectors
from sievestone.plans import catalogue


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString().lower()


def test_backward_carry_has_no_frame_that_is_read_anew_for_every_row(spark):
    rows = spark.createDataFrame([("a", i, float(i) if i % 3 == 0 else None) for i in range(20)] + [("b", 3, None), ("b", None, 1.0)], "p string, o int, v double")
    out = ranges.carried(rows, ["p"], "o", "v", backward=True)
    assert "unboundedfollowing" not in plan_of(out)
    found = {(r["p"], r["o"]): r["v"] for r in out.collect()}
    assert all(found["a", i] == (None if i > 18 else float(-(-i // 3) * 3)) for i in range(20))
    assert found["b", 3] is None and found["b", None] == 1.0


def test_coherence_is_judged_on_the_answers_as_they_are(spark, tmp_path):
    rows = [(1, 0, "user", "Name a tree"), (1, 1, "assistant", "I cannot help with that"), (2, 0, "user", "Say a word of two"), (2, 1, "assistant", "word of two"), (3, 0, "user", "Why?"), (3, 1, "assistant", "Because it rains.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r["conv_id"], r["issue"]) for r in catalogue.queries()["coherence_issues"](spark, str(tmp_path)).where("answer = 'given'").collect()}
    assert found == {(1, "refusal"), (2, "repetition")}


def test_near_rows_name_every_copy(spark, tmp_path):
    rows = [(1, 10.0, 5), (2, 10.0, 5), (3, 10.001, 5), (4, 90.0, 1), (5, 10.0, 5), (6, 0.0, 0), (7, 100.0, 24)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    df = catalogue.queries()["analysis_near_rows"](spark, str(tmp_path))
    found = sorted((r["key1"], r["key2"]) for r in df.collect())
    assert found == [(1, 2), (1, 3), (1, 5)]


def test_weighted_votes_do_not_depend_on_the_order_of_sums(spark):
    rows = [(1, "a", 0.1), (1, "a", 0.2), (1, "a", 0.3), (1, "b", 0.6), (2, "a", 0.25), (2, "b", 0.75)]
    a = spark.createDataFrame(rows, "sample_id int, label string, weight double").selectExpr("*", "1.0d as confidence", "'member' as role")
    found = {r["sample_id"]: (r["label"], r["support"]) for r in annotators.resolved(a, "weighted").collect()}
    assert found == {1: (None, 0.5), 2: ("b", 0.75)}  # 0.1 + 0.2 + 0.3 is more than 0.6 in doubles


def test_closest_is_exact_in_many_boxes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BOX_ROWS", 40)
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=(700, 2)), 2)
    a[:, 1] = np.round(a[:, 1])
    a[650:] = a[:50]  # copies
    a[600:610] = a[600]
    keys = list(range(700))
    keys[699] = 49  # a copy under the same key
    q = np.vstack([a[::3], [[50.0, 50.0]]])
    frame = lambda ks, x: spark.createDataFrame([(int(k), [float(y) for y in r]) for k, r in zip(ks, x, strict=True)], "key long, v array<double>")
    asked = frame([-1 - i for i in range(len(q))], q)
    found = {r["query"]: r["distance"] for r in vectors.closest(asked, frame(keys, a), "key", "v").collect()}
    assert len(found) == len(q)
    assert all(found[-1 - i] == pytest.approx(np.sqrt(((a - x) ** 2).sum(axis=1)).min(), abs=1e-12) for i, x in enumerate(q))
    own = {r["query"]: r["distance"] for r in vectors.closest(frame(keys, a), frame(keys, a), "key", "v").collect()}
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))
    d[np.array(keys)[:, None] == np.array(keys)[None]] = np.inf
    least = {}
    for k, x in zip(keys, d.min(axis=1), strict=True):
        least[k] = min(x, least.get(k, np.inf))
    assert own.keys() == least.keys() and all(own[k] == pytest.approx(x, abs=1e-12) for k, x in least.items())


def test_nearest_real_rows_are_not_compared_one_by_one(spark):
    rows = spark.range(50).select("id", F.col("id").cast("double").alias("x"))
    for df in (synthetic.memorisation(rows, rows, "id", ["x"]), synthetic.diversity(rows, "id", ["x"])):
        assert "cartesian" not in plan_of(df) and "nestedloop" not in plan_of(df)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_blocks_of_vectors_keep_the_nearest_of_all(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[200:240] = x[7]  # many ties
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)] + [(900, None), (901, [float("nan")] * 6)], "k long, v array<double>")
    found = {(r["query"], r["rank"]): (r["key"], r["similarity"]) for r in vectors.top_k(df, df, "k", "v", 4, metric, block=64).collect()}
    n = np.linalg.norm(x, axis=1)
    s = x @ x.T / (n[:, None] * n[None]) if metric == "cosine" else x @ x.T if metric == "dot" else 1 / (1 + np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)))
    assert len(found) == 1200
    for i in range(300):
        want = sorted((-round(s[i, j], 9), j) for j in range(300) if j != i)[:4]
        assert [found[i, r][0] for r in (1, 2, 3, 4)] == [j for _, j in want]
        assert all(found[i, r][1] == pytest.approx(s[i, want[r - 1][1]], abs=1e-12) for r in (1, 2, 3, 4))


def test_blocks_of_vectors_are_sent_once_a_strip(spark):
    df = spark.range(64).selectExpr("id as k", "array(cast(id as double), 1.0d) as v")
    for out in (vectors.top_k(df, df, "k", "v", 2, block=4), vectors.near_pairs(df, "k", "v", 0.9, 4), vectors.cross_matches(df, df, "k", "v", 0.9, 4)):
        assert "cartesian" not in plan_of(out) and "nestedloop" not in plan_of(out)
    assert vectors.near_pairs(df, "k", "v", 0.9, 4).count() == sum(1 for i in range(64) for j in range(i) if (i * j + 1) / ((i * i + 1) * (j * j + 1)) ** 0.5 >= 0.9)


def test_a_forest_scores_rows_once(spark):
    rows = spark.range(200).selectExpr("id", "cast(id % 17 as double) as x", "cast(id * id % 23 as double) as y")
    assert "mapinarrow" not in plan_of(outliers.isolation_forest(rows, "id", ["x", "y"], trees=3))


def test_slices_and_their_overlaps_come_from_one_scan(spark, monkeypatch):
    calls, own = [], causes.conditions
    monkeypatch.setattr(causes, "conditions", lambda *a, **k: calls.append(1) or own(*a, **k))
    rows = spark.range(2000).selectExpr("id", "cast(id % 10 as double) as x", "cast(id % 4 as string) as c", "id % 4 <> 1 or id % 10 > 5 as ok")
    found = causes.pruned_slices(rows, "ok", ["x"], ["c"]).collect()
    assert len(calls) == 1 and found
    worst = found[0]
    assert worst["slice"] == "x:q0 & c=1" and worst["rows"] == 100 and worst["accuracy"] == 0.0


def test_words_of_a_text_are_taken_once_for_its_shingles(spark):
    texts = spark.createDataFrame([(1, "One two THREE vier \u00dcnf six"), (2, "a b"), (3, "?!"), (4, None), (None, "one two")], "k long, body string")
    out = contamination.shingles(texts, "k", "body", 5, "key")
    assert "regexp" not in plan_of(out) and plan_of(out).count("mapinarrow") >= 1
    assert sorted(r["key"] for r in out.collect()) == [1, 1, 2]
    assert "regexp" not in plan_of(contamination.contained_pairs(texts, texts, "k", "body", "k", "body"))


def test_near_rows_are_counted_and_grouped_without_listing_pairs(spark):
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(size=(260, 2)))
    x[:40] = x[0]  # copies
    x[258:] = 0.0
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)] + [(900, None), (None, [1.0, 0.0])], "k long, v array<double>")
    n = np.linalg.norm(x, axis=1)
    near = x @ x.T / np.where(n[:, None] * n[None] > 0, n[:, None] * n[None], 1.0) >= 0.99995
    np.fill_diagonal(near, False)
    group = np.arange(260)
    while True:
        least = np.minimum(group, np.where(near, group[None], 260).min(axis=1))
        if (least == group).all():
            break
        group = least
    found = {r["key"]: (r["links"], r["group"]) for r in vectors.near_links(df, "k", "v", 0.99995, 32).collect()}
    assert found == {i: (near[i].sum(), group[i]) for i in range(260)} and 3 < len(set(group)) < 220


def test_fuzzy_pairs_have_one_row_for_each_supplier(spark, tmp_path):
    rows = [(i, f"s{i}", 0 if i < 300 else i % 25, float(i)) for i in range(400)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = catalogue.queries()["fuzzy_pairs"](spark, str(tmp_path)).collect()
    assert len(found) == 400 and max(r["links"] for r in found) >= 298


def test_pairs_of_like_texts_are_multiplied_out_where_they_meet(spark):
    text = lambda i, more="": " ".join(f"w{i * 7 % 31 + j}x{i // 8}" for j in range(12)) + more
    frame = lambda rows: spark.createDataFrame(rows, "k long, body string")
    tests, train = frame([(i, text(i)) for i in range(20)] + [(50, None), (51, "?")]), frame([(100 + i, text(i % 20)) for i in range(60)] + [(300, None)])
    out = contamination.similar_pairs(tests, train, "k", "body", "k", "body", 0.9)
    plan = plan_of(out)
    assert "regexp" not in plan and " join " not in plan.split("== physical plan ==")[0].split("== optimized logical plan ==")[1]
    found = {(r["test_key"], r["train_key"]) for r in out.where("similarity > 0.999999").collect()}
    assert found == {(i, 100 + i + j) for i in range(20) for j in (0, 20, 40)}
    twice = frame([(1, text(1)[:20]), (1, text(1)[20:])])  # rows of one key are one text
    assert contamination.similar_pairs(twice, train, "k", "body", "k", "body", 0.5).count() >= 3


def test_numbers_of_samples_without_their_rows(spark):
    rows = [(i, None if i % 11 == 0 else "abc"[i % 7 % 3], None if i % 13 == 0 else float(i % 9), None if i % 5 == 0 else i % 4 * 1.5, float(i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, c string, x double, y double, z double")
    own = {"spoil": {"x": F.when(F.col("id") % 2 == 0, F.col("x") * 50), "y": F.lit(None).cast("double")}, "most": 0.8}
    rest = ("c", ["x", "y", "z"], {"x": (0.0, 100.0)})
    plain = {r.table: r for r in predictor.table_numbers(predictor.bootstrap_tables(df, "id", 150, **own), *rest).collect()}
    found = {r.table: r for r in predictor.bootstrap_numbers(df, "id", 150, *rest, **own).collect()}
    assert found.keys() == plain.keys() and len(found) == 150
    assert all(abs(x - y) < 1e-9 for k in plain for x, y in zip(plain[k], found[k], strict=True))
    tables = predictor.bootstrap_tables(df, "id", 150, **own)
    different = {r.table: r.k for r in tables.select("table", "c", "x", "y", "z").distinct().groupBy("table").agg(F.count("*").alias("k")).collect()}
    size = {r.table: r["count"] for r in tables.groupBy("table").count().collect()}
    assert all(abs(found[k].duplicate_rate - (size[k] - different[k]) / size[k]) < 1e-12 for k in size)
    flat = predictor.bootstrap_numbers(df.withColumn("x", F.lit(7.1)), "id", 3, *rest).collect()  # a column of one value has no skew
    assert len(flat) == 3 and all(0 <= r.mean_skew < 1 and r.mean_correlation < 0.2 for r in flat)
    assert not predictor.bootstrap_numbers(df.where("id < 0"), "id", 150, *rest, **own).collect()
