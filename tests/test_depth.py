"""Contamination by text, mergeable reports and grouped quantiles against plain code."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.functions.quantiles import grouped_quantiles
from sievestone.operators import contamination, sketches

ROWS = "k long, body string, weight double, w string"


def plain_words(text):
    return re.findall(contamination.WORD, (text or "").translate(str.maketrans(contamination.UPPER, contamination.LOWER)))


def plain_shingles(text, n):
    w = plain_words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def texts():
    """Two lists of (key, text): copies, parts, one passage in half of the training texts, odd texts."""
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(120)]
    write = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = write(12)
    tests = [write(rng.randrange(6, 40)) for _ in range(12)] + [common, "Two words", "", None, "Ünï cödé, naïve; text! one two three", "x", common + " " + write(2)]
    train = [write(60) for _ in range(20)]
    for i, text in enumerate(tests):
        if text and i % 2:
            w = text.split()
            train.append(write(10) + " " + " ".join(w[: max(1, int(0.9 * len(w)))]) + " " + write(9))
            train.append(text.upper())
    train += [f"{write(3)} {common} {write(3)}" for _ in range(25)] + [None, "", "?!", "one two three " * 3000]
    return list(enumerate(tests)) + [(None, common)], [(100 + i, x) for i, x in enumerate(train)] + [(None, common)]


def tables(spark, texts):
    return [spark.createDataFrame([(k, x, 1.0, "w") for k, x in side], ROWS) for side in texts]


def test_containment(spark, texts):
    tests, train = texts
    want = {}
    for k, x in tests:
        s = plain_shingles(x, 5)
        for j, y in train:
            if k is not None and j is not None and s and (c := len(s & plain_shingles(y, 5)) / len(s)) >= 0.8 - 1e-9:
                want[k, j] = c
    got = {(r.test_key, r.train_key): r.containment for r in contamination.contained_pairs(*tables(spark, texts), "k", "body", "k", "body").collect()}
    assert got.keys() == want.keys() and len(want) > 30 and all(math.isclose(got[p], want[p]) for p in want)
    one = {r.test_key: (r.matches, r.severity) for r in contamination.containment(*tables(spark, texts), "k", "body", "k", "body").collect()}
    assert one[12][0] == sum(k == 12 for k, _ in want) and one[12][1] == "critical"
    empty = tables(spark, texts)[0].where("k > 1000")
    assert contamination.containment(empty, tables(spark, texts)[1], "k", "body", "k", "body").collect() == []


@pytest.mark.parametrize("least", [0.9, 0.5])
def test_similarity_with_one_rarity(spark, texts, least):
    tests, train = ([(k, x) for k, x in side if k is not None] for side in texts)
    counts = {("a", k): [w for w in plain_words(x) if len(w) > 1] for k, x in tests} | {("b", k): [w for w in plain_words(x) if len(w) > 1] for k, x in train}
    n = len(counts)
    seen = {}
    for ws in counts.values():
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
    vectors = {}
    for k, ws in counts.items():
        v = {w: ws.count(w) * (1 + math.log((1 + n) / (1 + seen[w]))) for w in set(ws)}
        length = math.sqrt(sum(x * x for x in v.values()))
        vectors[k] = {w: x / length for w, x in v.items()}
    want = {}
    for (s, k), v in vectors.items():
        for (r, j), u in vectors.items():
            if s == "a" and r == "b" and (c := sum(x * u.get(w, 0) for w, x in v.items())) >= least - 1e-9:
                want[k, j] = c
    got = {(r.test_key, r.train_key): r.similarity for r in contamination.similar_pairs(*tables(spark, texts), "k", "body", "k", "body", least).collect()}
    assert got.keys() == want.keys() and want and all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in want)


def test_reports_merge_as_their_union(spark):
    rng = np.random.default_rng(1)
    values = [(int(i % 7) if i % 50 else None, float(x) if i % 9 else None, float(i % 300), None) for i, x in enumerate(rng.normal(5, 2, 6000))]
    df = spark.createDataFrame(values, "chunk int, a double, b double, none double")
    parts = [sketches.chunk_sketches(df.where(F.coalesce(F.col("chunk") % 2, F.lit(0)) == k), ["a", "b", "none"]) for k in (0, 1)]
    merged = {r.column: r for r in sketches.read_sketches(sketches.merge_sketches(*parts)).collect()}
    whole = {r.column: r for r in sketches.read_sketches(sketches.merge_sketches(sketches.chunk_sketches(df, ["a", "b", "none"]))).collect()}
    for i, c in enumerate("ab", 1):
        x = np.array([v[i] for v in values if v[i] is not None])
        for r in (merged[c], whole[c]):
            assert (r.rows, r.missing, r.least, r.greatest) == (6000, 6000 - len(x), x.min(), x.max())
            assert math.isclose(r.mean, x.mean()) and math.isclose(r.std, x.std())
            assert abs(r.distinct - len(set(x))) <= sketches.DISTINCT_ERROR * len(set(x))
            for q, p in ((r.q1, 0.25), (r.median, 0.5), (r.q3, 0.75)):
                assert (x < q).mean() - sketches.RANK_ERROR <= p <= (x <= q).mean() + sketches.RANK_ERROR
    assert merged["none"].median is None and merged["none"].missing == 6000
    report = sketches.chunk_sketches(df, ["a", "b"])
    assert sketches.merge_sketches(report, by=["chunk"]).count() == 16  # null chunks are one more
    shifted = df.withColumn("a", F.when(F.col("chunk") == 3, F.col("a") + 40).otherwise(F.col("a")))
    own = sketches.chunk_sketches(shifted, ["a"])
    judged = sketches.judged_chunks(own, sketches.merge_sketches(own)).where("drifted").collect()
    assert [r.chunk for r in judged] == [3]


def test_quantiles_of_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, 1.0, 2.0, 2.0, rng.random()]), float(rng.randrange(5))) for _ in range(500)] + [("none", None, 1.0)]
    got = {r.g: r for r in grouped_quantiles(spark.createDataFrame(rows, "g string, a double, b double"), "g", ["a", "b"], [0.0, 0.25, 0.9]).collect()}
    assert got["none"].a is None
    for g in ("x", "y", None):
        for i, c in ((1, "a"), (2, "b")):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None]
            assert np.allclose(got[g][c], np.quantile(values, [0.0, 0.25, 0.9]))
