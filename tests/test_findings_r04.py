"""Findings of the fourth round: each test fails on the code before its mend."""

import uuid

import numpy as np

from sievestone.functions import working
from sievestone.operators import contamination, duplicates, vectors
from sievestone.plans import catalogue


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString().lower()


def test_near_pairs_meet_in_bounded_blocks_that_are_not_broadcast(spark):
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(400, 2)))
    x[:150] = x[0]  # a hot group
    x[398:] = 0.0
    n = np.linalg.norm(x, axis=1)[:, None]
    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    df = spark.createDataFrame([(f"k{i:03}", [float(y) for y in r]) for i, r in enumerate(x)] + [(None, [1.0, 0.0]), ("n", None), ("nan", [float("nan"), 0.0])], "k string, v array<double>")
    for threshold in (0.999, 1.0):
        out = duplicates.near_pairs(df, "k", threshold, 32)
        assert "broadcast" not in plan_of(out)
        found = sorted((r["key1"], r["key2"]) for r in out.collect())
        near = (x @ x.T >= threshold) | (x[:, None] == x[None]).all(axis=2) & (n > 0)
        assert found == [(f"k{i:03}", f"k{j:03}") for i in range(400) for j in range(i + 1, 400) if near[i, j]] and len(found) >= 150 * 149 // 2
    assert not duplicates.near_pairs(df.limit(0), "k", 0.9).collect()


def test_near_rows_are_all_pairs_and_copies_too(spark, tmp_path):
    rows = [(1, 10.0, 5), (2, 10.0, 5), (3, 10.001, 5), (4, 90.0, 1), (5, 10.0, 5), (6, 0.0, 0), (7, 100.0, 24), (8, 0.0, 0)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    df = catalogue.queries()["analysis_near_rows"](spark, str(tmp_path))
    found = sorted((r["key1"], r["key2"]) for r in df.collect())
    assert found == [(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5), (6, 8)]


def test_fuzzy_pairs_lists_all_pairs(spark, tmp_path):
    rows = [(i, f"s{i}", 0 if i < 30 else 1 + i % 24, float(i)) for i in range(60)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = {(r["key1"], r["key2"]) for r in catalogue.queries()["fuzzy_pairs"](spark, str(tmp_path)).collect()}
    x = np.array([[r[3] / 59, r[2] / 24] for r in rows])
    n = np.linalg.norm(x, axis=1)[:, None]
    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    assert found == {(i, j) for i in range(60) for j in range(i + 1, 60) if x[i] @ x[j] >= 0.9995} and len(found) >= 29 * 28 // 2


def test_like_texts_leave_one_table_and_meet_in_rounds(spark, monkeypatch, tmp_path):
    text = lambda i: " ".join(f"w{i * 7 % 31 + j}x{i // 8}" for j in range(12)) + " the of"
    frame = lambda rows: spark.createDataFrame(rows, "k long, body string")
    tests, train = frame([(i, text(i)) for i in range(20)] + [(50, None), (51, "?")]), frame([(100 + i, text(i % 20)) for i in range(60)] + [(300, None), (None, text(1))])
    pairs = lambda: {(r["test_key"], r["train_key"]): round(r["similarity"], 9) for r in contamination.similar_pairs(tests, train, "k", "body", "k", "body", 0.5).collect()}
    folder = lambda spark: f"file://{tmp_path}/{uuid.uuid4().hex}"
    monkeypatch.setattr(working, "shared_folder", folder)
    want = pairs()
    assert sum(any(x.suffix == ".parquet" for x in folder.iterdir()) for folder in tmp_path.iterdir()) == 1  # the vectors
    for name, value in (("STRIP_TEXTS", 3), ("ROUND_STRIPS", 2), ("BROADCAST_ROWS", 5)):
        monkeypatch.setattr(contamination, name, value)
    assert pairs() == want and {(i, 100 + i + j) for i in range(20) for j in (0, 20, 40)} <= want.keys()


def test_near_pairs_are_counted_without_listing_them(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 3))
    x[:40] = x[0]  # copies
    x[40:60] = x[0] * rng.uniform(1, 2, size=(20, 1))  # other lengths
    x[149] = 0.0
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)] + [(900, None), (None, [1.0, 0.0, 0.0])], "k long, v array<double>")
    tables, write = [], vectors.written
    monkeypatch.setattr(vectors, "written", lambda df, *a, **k: tables.append(write(df, *a, **k)) or tables[-1])
    n = np.linalg.norm(x, axis=1)
    near = x[:149] @ x[:149].T / (n[:149, None] * n[None, :149]) >= 0.9
    assert vectors.count_near_pairs(df, "k", "v", 0.9, 16).first()[0] == np.triu(near, 1).sum()
    assert max(t.count() for t in tables) <= 150  # vectors, and a row for blocks that met
    assert vectors.count_near_pairs(df.limit(0), "k", "v", 0.9, 16).first()[0] == 0
