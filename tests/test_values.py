"""Registered queries without SQL: their values against plain code, on the smallest tables."""

import math
import statistics
from collections import Counter

import numpy as np
import pytest

from sievestone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark):
    return lambda name: catalogue.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_isolation_forest(result, table):
    rows = result("isolation_forest")
    scores = [r.score for r in rows]
    assert len(rows) == len(table("lineitem")) and all(0 < s < 1 for s in scores)
    cut = float(np.quantile(scores, 0.9))
    assert all(r.is_outlier == (r.score > cut) for r in rows)
    assert {r.key: r.score for r in result("isolation_forest")} == {r.key: r.score for r in rows}


def test_label_errors_are_off_the_confident_diagonal(result, table):
    given = {r.vec_id: r.label for r in table("embeddings") if r.label is not None}
    codes = {label: i for i, label in enumerate(sorted(set(given.values())))}
    rows = result("label_errors_cross_validated")
    assert rows and len({r.vec_id for r in rows}) == len(rows)
    assert all(r.given == codes[given[r.vec_id]] and r.predicted != r.given and 0 <= r.predicted < len(codes) and 0 <= r.self_confidence < 1 for r in rows)


def test_principal_components(result, table):
    x = np.array([r.embedding for r in sorted(table("embeddings"), key=lambda r: r.vec_id)], float)
    x -= x.mean(axis=0)
    _, s, axes = np.linalg.svd(x, full_matrices=False)
    got = np.array([list(r.x) for r in sorted(result("principal_components"), key=lambda r: r.vec_id)])
    want = x @ axes[:2].T
    assert s[1] - s[2] > 1e-6
    for k in range(2):
        assert np.allclose(got[:, k], want[:, k], atol=1e-6) or np.allclose(got[:, k], -want[:, k], atol=1e-6)


def test_clusters_are_of_the_nearest_mean(result, table):
    x = {r.vec_id: np.array(r.embedding, float) for r in table("embeddings")}
    rows = result("vector_clusters")
    of = {r.vec_id: r.cluster for r in rows}
    assert of.keys() == x.keys() and len(set(of.values())) == 5
    means = {c: np.mean([x[k] for k in x if of[k] == c], axis=0) for c in set(of.values())}
    near = sum(min(means, key=lambda c: np.linalg.norm(x[k] - means[c])) == of[k] for k in x)
    assert near >= 0.9 * len(x)


def test_samples_are_the_same_on_every_run(result, table):
    one, two = ({r.o_orderkey for r in result("sampled_rows")} for _ in range(2))
    assert one == two and len(one) == 1000 and one <= {r.o_orderkey for r in table("orders")}


def test_drift_report(result, table):
    events = table("events")
    a, b = ([r for r in events if (r.event_id % 3 != 0) == side] for side in (True, False))
    rows = {r.feature: r for r in result("drift_report")}
    x, y = (np.sort([r.value for r in s]) for s in (a, b))
    every = np.concatenate([x, y])
    ks = np.abs(np.searchsorted(x, every, "right") / len(x) - np.searchsorted(y, every, "right") / len(y)).max()
    n = math.sqrt(len(x) * len(y) / (len(x) + len(y)))
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * (n * ks) ** 2) for k in range(1, 101))
    assert math.isclose(rows["value"].score, ks) and abs(rows["value"].p_value - min(1.0, p)) < 0.02
    p, q = (Counter(r.event_type for r in s) for s in (a, b))
    chi2 = sum((1000 * q[c] / len(b) - 1000 * p[c] / len(a)) ** 2 / (1000 * p[c] / len(a)) for c in p)
    assert math.isclose(rows["event_type"].score, chi2 / 1000)
    for r in rows.values():
        assert r.has_drift == (r.p_value < 0.05 or r.score > 0.1) and 0 <= r.p_value <= 1


def test_significant_causes(spark, result):
    from sievestone.plans.queries_stats import flagged

    rows = flagged(spark, SF).collect()
    n, k = len(rows), sum(bool(r.issue) for r in rows)
    want = set()
    for factor in ("event_type", "user_id"):
        for value, m in Counter(getattr(r, factor) for r in rows).items():
            a = sum(bool(r.issue) for r in rows if getattr(r, factor) == value)
            if m < 30 or not k:
                continue
            gap = max(0.0, abs(a * (n - m - (k - a)) - (m - a) * (k - a)) - n / 2)
            chi2 = n * gap * gap / (m * (n - m) * k * (n - k)) if m < n else 0.0
            if a / m / (k / n) >= 1.5 and math.erfc(math.sqrt(chi2 / 2)) <= 0.05:
                want.add((factor, str(value)))
    assert {(r.factor, r.value) for r in result("cause_significant")} == want


def test_weak_slices_are_significant(spark, result):
    from sievestone.plans.queries_stats import predicted

    rows = predicted(spark, SF).collect()
    n, bad = len(rows), sum(not r.correct for r in rows)

    def fisher(errors, size):
        """The chance of so many errors or more among ``size`` rows."""
        top = min(size, bad)
        return sum(math.comb(bad, e) * math.comb(n - bad, size - e) for e in range(errors, top + 1)) / math.comb(n, size)

    for r in result("weak_slices"):
        errors = round(r.rows * (1 - r.accuracy))
        assert r.gap >= 0.05 and r.p_value <= 0.05 and math.isclose(r.p_value, fisher(errors, r.rows), rel_tol=1e-3, abs_tol=1e-9)


def test_copula_keeps_moments(result, table):
    rows, real = result("gaussian_copula"), table("lineitem")
    assert len(rows) == 1000
    for c in ("l_quantity", "l_extendedprice"):
        x, y = [r[c] for r in rows], [r[c] for r in real]
        assert abs(statistics.mean(x) - statistics.mean(y)) < 0.15 * statistics.stdev(y) and abs(statistics.stdev(x) / statistics.stdev(y) - 1) < 0.1
    corr = lambda rows: np.corrcoef([r.l_quantity for r in rows], [r.l_extendedprice for r in rows])[0, 1]
    assert abs(corr(rows) - corr(real)) < 0.08


def test_smote_points_lie_between_neighbours(result, table):
    x = {r.vec_id: np.array(r.embedding, float) for r in table("embeddings") if r.label == 1}
    for r in result("smote")[:200]:
        a, v = x[r.key], np.array(r.v)
        near = sorted(((np.linalg.norm(a - b), k) for k, b in x.items() if k != r.key))[:5]
        gaps = []
        for _, k in near:
            d = x[k] - a
            share = float(np.dot(v - a, d) / np.dot(d, d))
            gaps.append(np.linalg.norm(a + share * d - v) if -1e-9 <= share <= 1 else math.inf)
        assert min(gaps) < 1e-5


def test_advice_and_automatic_analysis(result, table):
    rows = result("analysis_advice")
    n = len(table("documents"))
    rank = ["critical", "high", "medium", "low"]
    assert [rank.index(r.priority) for r in rows] == sorted(rank.index(r.priority) for r in rows)
    texts = Counter((r.text, r.n_chars) for r in table("documents"))
    assert all(math.isclose(r.share, r.n / n) for r in rows) and {r.kind: r.n for r in rows}["duplicates"] <= n - len(texts)
    (one,) = result("analysis_automatic")
    assert (one.label, one.task, one.n_samples) == ("label", "classification", len(table("embeddings")))


def test_centres_cover_all_vectors(result, table):
    rows = result("k_centers")
    assert len(rows) == 25 and sum(r.rows for r in rows) == len(table("embeddings"))
    x = {r.vec_id: np.array(r.embedding, float) for r in table("embeddings")}
    centres = [r.centre for r in rows]
    radius = max(min(np.linalg.norm(v - x[c]) for c in centres) for v in x.values())
    assert math.isclose(max(r.radius for r in rows), radius, rel_tol=1e-6)


def test_categories_follow_the_customers(result, table):
    real, drawn = Counter(r.c_mktsegment for r in table("customer")), Counter(r.c_mktsegment for r in result("drawn_categories"))
    n, m = sum(real.values()), sum(drawn.values())
    assert m == len(table("orders")) and all(abs(drawn[c] / m - k / n) < 0.05 for c, k in real.items())


def test_points_between_toxic_documents(result, table):
    toxic = {r.doc_id for r in table("labels") if r.toxic == 1}
    size = {r.doc_id: r.n_chars for r in table("documents")}
    rows = result("interpolated_rows")
    assert rows and all({r.source, r.partner} <= toxic and min(size[r.source], size[r.partner]) <= r.n_chars <= max(size[r.source], size[r.partner]) for r in rows)


def test_forecasts_hold_the_quality(result):
    rows = result("quality_forecast")
    assert len(rows) == 120 and sum(r.low - 1e-9 <= r.quality <= r.high + 1e-9 for r in rows) >= 0.85 * len(rows)


def test_a_tree_follows_the_forest(result, table):
    rows = result("distilled_scores")
    assert len(rows) == len(table("events"))
    x, y = np.array([r.student for r in rows]), np.array([r.score for r in rows])
    assert np.corrcoef(x, y)[0, 1] > 0.8 and np.abs(x - y).mean() < 0.5 * np.abs(y - y.mean()).mean()
