"""Versions, centres, draws, the issue graph, thresholds, drift of batches, places of personal data and pruned slices against plain code."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.functions.working import shared_folder
from sievestone.operators import causes, coresets, drift, graph, privacy, thresholds
from sievestone.plans.versions import Versions


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def store(spark):
    own = Versions(spark, shared_folder(spark), ["k"], buckets=8)
    base = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).cast("double").alias("x"), F.lit(None).cast("string").alias("s"))
    first = own.commit(base, "first")
    second = own.commit(base.where("k <> 3").withColumn("x", F.when(F.col("k") == 5, -1.0).otherwise(F.col("x"))).unionByName(base.where("k = 7").withColumn("k", F.lit(99).cast("long"))), "second")
    return own, base, first, second


def test_versions_and_differences(store):
    own, base, first, second = store
    assert rows_of(own.read(first)) == rows_of(base) and own.read("main").count() == 40
    assert rows_of(own.diff(first, second)) == [(3, "removed"), (5, "changed"), (99, "added")]
    assert [(r.message, r.depth, r.rows) for r in own.log("main").collect()] == [("second", 0, 40), ("first", 1, 40)]
    again = own.commit(own.read(first).orderBy(F.desc("k")), "as the first")
    assert own.diff(first, again).count() == 0 and own.version(again[:12]) == again
    own.point("main", second)
    own.point("stable", first)
    assert own.version("stable") == first and own.version("main") == second
    with pytest.raises(KeyError):
        own.read("nowhere")


def test_a_difference_reads_changed_buckets_alone(store):
    own, _, first, second = store
    changed = own.changed_buckets(first, second)
    assert 0 < len(changed) <= 3 < own.buckets
    read = {re.search("address=([0-9a-f]+)", f)[1] for f in own.diff(first, second).inputFiles()}
    assert read == {a for c in changed for a in c[1:] if a}
    written = {re.search("address=([0-9a-f]+)", f)[1] for f in own.read(second).inputFiles()}
    assert len(written & {re.search("address=([0-9a-f]+)", f)[1] for f in own.read(first).inputFiles()}) == 8 - len(changed)


def test_merges(store):
    own, base, first, _ = store
    own.point("left", first)
    own.point("right", first)
    own.commit(base.withColumn("x", F.when(F.col("k") % 10 == 1, 0.5).otherwise(F.col("x"))), "left", "left")
    own.commit(base.where("k % 10 <> 2").withColumn("s", F.when(F.col("k") == 4, "new")), "right", "right")
    version, clashes = own.merge("left", "right", "both")
    assert clashes.count() == 0 and own.version("left") == version
    want = base.where("k % 10 <> 2").withColumn("x", F.when(F.col("k") % 10 == 1, 0.5).otherwise(F.col("x"))).withColumn("s", F.when(F.col("k") == 4, "new"))
    assert rows_of(own.read("left")) == rows_of(want)
    own.commit(base.withColumn("x", F.when(F.col("k") == 1, 7.0).otherwise(F.col("x"))), "against", "right")
    version, clashes = own.merge("left", "right", "no")
    assert version is None and rows_of(clashes) == [(1,)]


def test_empty_and_repeated_rows(spark):
    own = Versions(spark, shared_folder(spark), ["k"], buckets=4)
    none = spark.createDataFrame([], "k long, v string")
    two = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k long, v string")
    a, b, c = own.commit(none, "none"), own.commit(two, "two"), own.commit(two.distinct(), "one each")
    assert own.read(a).collect() == [] and own.read(b).count() == 3
    assert rows_of(own.diff(a, b)) == [(1, "added"), (None, "added")] and rows_of(own.diff(b, c)) == [(1, "changed")]


@pytest.mark.parametrize("block, factor", [(1000, 2), (8, 4)])
def test_centres_cover(spark, block, factor):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(14, 2)).round(3)
    best = min(max(min(math.dist(p, points[i]) for i in chosen) for p in points) for chosen in combinations(range(len(points)), 4))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(50, None), (None, [0.0, 0.0])], "k long, v array<double>").coalesce(1)
    centres = coresets.k_centers(rows, "k", "v", 4, block=block)
    got = coresets.covered(rows, "k", "v", centres).collect()
    assert len(got) == 14 and max(r.distance for r in got) <= factor * best + 1e-9
    assert len(coresets.k_centers(spark.createDataFrame([(i, [1.0]) for i in range(5)], "k long, v array<double>"), "k", "v", 3).collect()) == 1  # equal rows need one


def test_weighted_draws(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 4 == 0, 10.0).when(F.col("id") % 4 == 1, 1.0).when(F.col("id") % 4 == 2, 0.0).alias("w"))
    got = [r.k % 4 for r in coresets.weighted_sample(df, "k", "w", 200).collect()]
    assert len(got) == 200 and not set(got) & {2, 3} and 160 <= got.count(0) <= 199
    assert coresets.weighted_sample(df, "k", "w", 10_000).count() == 2000
    assert [r.k for r in coresets.weighted_sample(df, "k", "w", 5, seed=1).collect()] != [r.k for r in coresets.weighted_sample(df, "k", "w", 5, seed=2).collect()]


def test_mass_goes_along_all_paths(spark):
    links = [("a", "b", 0.5), ("a", "c", 1.0), ("b", "d", 2.0), ("c", "d", 1.0), ("d", "a", 0.1), ("a", "b", 0.25)]
    df = spark.createDataFrame(links, "source string, target string, weight double")
    start = spark.createDataFrame([("a", 1.0), ("x", 3.0)], "node string, m double")
    want = {"a": 1.0, "x": 3.0}
    now = dict(want)
    for _ in range(3):
        step = {}
        for s, t, w in links:
            step[t] = step.get(t, 0) + now.get(s, 0) * w * 0.9
        for n, m in step.items():
            want[n] = want.get(n, 0) + m
        now = step
    got = {r.node: r.m for r in graph.propagated(start, df, ["m"], 3, 0.9).collect()}
    assert got.keys() == {n for n, m in want.items() if m} and all(math.isclose(got[n], want[n]) for n in got)
    nodes = graph.issue_nodes({"outlier": spark.createDataFrame([(1, 0.4), (1, 0.9), (None, 1.0)], "k long, confidence double"), "missing": spark.createDataFrame([(1,)], "k long")}, "k")
    one = graph.whole_impact(nodes).first()
    assert (one.issues, one.rows) == (2, 1) and math.isclose(one.accuracy, 0.005 * 0.9 + 0.001 * 0.5)
    assert graph.whole_impact(nodes.limit(0)).first().confidence == 1.0


def test_thresholds_equal_a_loop(spark):
    rng = random.Random(6)
    rows = [(i % 3, rng.choice([None, 0.5, rng.random()]), rng.choice([0, 1, 1, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "fold int, s double, y int")
    cuts = [0.2, 0.5, 0.9]

    def measure(rows, t):
        tp = sum(s is not None and s >= t and y == 1 for _, s, y in rows)
        fp = sum(s is not None and s >= t and y == 0 for _, s, y in rows)
        fn = sum(y == 1 for *_, y in rows) - tp
        return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0

    known = [r for r in rows if r[2] is not None]
    got = {r.threshold: r.f1 for r in thresholds.threshold_grid(df, "s", "y", cuts).collect()}
    assert all(math.isclose(got[t], measure(known, t)) for t in cuts)
    for r in thresholds.cross_validated(df, "s", "y", cuts, F.col("fold")).collect():
        rest, own = [x for x in known if x[0] != r.fold], [x for x in known if x[0] == r.fold]
        best = max(cuts, key=lambda t: (round(measure(rest, t), 12), -t))
        assert r.threshold == best and math.isclose(r.train_score, measure(rest, best)) and math.isclose(r.test_score, measure(own, best))
    assert thresholds.tuned(df, "s", "y", cuts, F.col("fold")).first().threshold == max(cuts, key=lambda t: (round(measure(known, t), 12), -t))


def test_a_repeated_batch_counts_once(spark, tmp_path):
    reference = spark.range(1000).select((F.col("id") % 100).cast("double").alias("a"), F.lit(1.0).alias("b"))
    batches = [reference, reference.withColumn("a", F.col("a") / 2), reference.withColumn("a", F.lit(5.0))]
    monitor = drift.BatchMonitor(str(tmp_path / "m"), reference, ["a", "b"])
    for n in (0, 1, 1, 2, 0):
        monitor(batches[n], n)
    every = None
    for n, b in enumerate(batches):
        one = b.withColumn("batch", F.lit(n).cast("long"))
        every = one if every is None else every.unionByName(one)
    want = {(r.batch, r.feature): r.psi for r in drift.numeric_monitor(drift.reference_bins(reference, ["a", "b"]), every, "batch").collect()}
    got = {(r.batch, r.feature): (r.psi, r.alert) for r in monitor.history().collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k][0], want[k], abs_tol=1e-12) for k in want)
    assert not got[0, "a"][1] and got[1, "a"][1] and got[2, "a"][1] and not got[2, "b"][1]
    assert {r.feature: r.direction for r in monitor.trend().collect()} == {"a": "rising", "b": "stable"}
    assert {r.feature for r in monitor.recent(2).where("alert").collect()} == {"a"}


def test_a_stream_feeds_the_monitor(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 20).cast("double").alias("a"))
    monitor = drift.BatchMonitor(str(tmp_path / "m"), rows, ["a"], bins=4)
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("a double").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in")).writeStream.foreachBatch(monitor).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert monitor.counts().agg(F.sum("n")).first()[0] == 200 and monitor.history().count() == 2


def test_places_of_personal_data(spark):
    texts = ["call 555-123-4567 or a.b@c.org, ssn 123-45-6789", None, "nothing", "4111 1111 1111 1111 and 1234567890123456", "Ünï x@y.de 10.0.0.1 " * 3, "born 01/02/1990"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    want = []
    for k, text in enumerate(texts):
        own = [(m.start(), m.end(), kind, m.group()) for kind, (patterns, _) in privacy.PII.items() for p in patterns for m in re.finditer(p, text or "", re.IGNORECASE | re.ASCII)]
        want += [(k, kind, s, e, v, sum(a < e and s < b for a, b, _, _ in own) - 1) for s, e, kind, v in own]
    got = [(r.k, r.pii_type, r.start, r.end, r.value, r.overlaps) for r in privacy.spans(df, "k", ["text"]).collect()]
    assert sorted(got) == sorted(want) and any(o for *_, o in want)
    assert [texts[k][s:e] for k, _, s, e, _, _ in got] == [v for *_, v, _ in got]
    assert sorted((r.k, r.pii_type, r.value) for r in privacy.scan(df, "k", ["text"]).collect()) == sorted((k, kind, v) for k, kind, _, _, v, _ in want)


def test_slices_are_pruned_as_by_sets_of_rows(spark):
    rng = random.Random(8)
    rows = [(i, rng.random(), rng.choice("ab"), rng.choice("xyz")) for i in range(3000)]
    rows = [(i, v, a, "x" if a == "a" and rng.random() < 0.97 else b) for i, v, a, b in rows]
    rows = [(i, v, a, b, not (a == "a" and v < 0.7) and rng.random() < 0.9) for i, v, a, b in rows]
    df = spark.createDataFrame(rows, "k long, v double, a string, b string, ok boolean")
    got = [(r.slice, r.rows) for r in causes.pruned_slices(df, "ok", ["v"], ["a", "b"]).collect()]
    found = causes.slices(df, "ok", ["v"], ["a", "b"], 2).where("gap >= 0.05").collect()
    members = {s.slice: set() for s in found}
    for r in causes.conditions(df, ["v"], ["a", "b"]).collect():
        for n in (1, 2):
            for c in combinations(r.conditions, n):
                members.get(" & ".join(c), set()).add(r.k)
    kept = []
    for s in sorted(found, key=lambda s: (-round(s.gap, 12), s.slice)):
        own = members[s.slice]
        assert len(own) == s.rows
        if not any(len(own & members[k.slice]) > 0.9 * len(own) and abs(k.gap - s.gap) <= 0.02 for k in kept):
            kept.append(s)
    assert got == [(s.slice, s.rows) for s in kept] and len(kept) < len(found)
