"""Decontamination, URL rules, vector search, quality and language, against brute force or held-out rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.llm import decontamination as decon
from sievestone.llm import language_id, quality, queries, url_filter, vector_search
from sievestone.llm.vector_search import nearest

SF = "/root/testdata/sf0.01"


def brute_hits(texts, items, n=10):
    windows = {}
    for i, t in items:
        if i is not None:
            for w in decon.windows_of(t, n):
                windows.setdefault(tuple(w.split(b" ")), set()).add(i)
    out = []
    for d, t in texts:
        w, hit, found = decon.words_of(t), set(), set()
        for size in {len(k) for k in windows}:
            for at in range(len(w) - size + 1):
                if tuple(w[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
                    found |= windows[tuple(w[at : at + size])]
        out.append((str(d), len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block_rows", [5, 1_000_000])
def test_decontamination(spark, block_rows):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, "été ça"), (4, None), (None, "never counted words"), (5, ""), (6, "short ITEM"), (7, "a a a a a a a a a a a a")]
    texts = [(0, "x One two, three-four five six seven eight nine ten! y"), (1, "a short  item here; été ça"), (2, None), (3, ""), (4, "!!!"), (5, "one two three"), (None, "short item"), (6, "a " * 30), (6, "a " * 30), (7, "two three four five six seven eight nine ten eleven twelve short item")]
    df = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decon.contamination(df, bench, block_rows=block_rows).collect()
    assert sorted((str(r.doc_id), r.n_words, sum(s.words for s in r.spans), list(r["items"])) for r in rows) == brute_hits(texts, items)
    kept = decon.decontaminate(df, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "5"] and kept.columns == df.columns
    cut = {r.doc_id: r.text for r in decon.decontaminate(df, bench, spans_only=True).collect()}
    assert cut[0] == "x ! y" and cut[1] == "a  here; " and cut[2] is None
    same = spark.createDataFrame([(1, "a short item here", 1), (1, "a perfectly harmless", 2), (None, "harmless too", 3), (None, "the short item", 4)], "doc_id long, text string, spans int").withColumn("row_key", F.lit(0))
    assert sorted(r.spans for r in decon.decontaminate(same, bench).collect()) == [2, 3]
    assert {r.spans: r.text for r in decon.decontaminate(same, bench, spans_only=True).collect()} == {1: "a  here", 2: "a perfectly harmless", 3: "harmless too", 4: "the "}
    assert decon.contamination(df.limit(0), bench).count() == 0
    assert all(not r.spans for r in decon.contamination(df, bench.limit(0)).collect())


@pytest.mark.parametrize("most", [2, 400_000])
def test_url_rules(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
    urls = ["http://Example.ORG/es/x?y#z", "https://a.b.example.org/en/12", "http://example.org", "http://fr.com/fr/1", "http://com/de/", "nothing", None, "http://x.net/a", "http://notexample.org/es/", "http://org/", "ftp://EXAMPLE.org/ES/", "http://example.org:80/es/", "http://a.com/de/#://b"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, rule int")
    rules = spark.createDataFrame([*queries.RULES, (None, "/", "block")], "host string, path string, verdict string")

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            n = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
            host, rest = rest[:n].lower(), rest[n:]
            path = rest[: min([len(rest), *(rest.find(c) for c in "?#" if c in rest)])]
        fit = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    rows = url_filter.judge_urls(pages, rules).collect()
    assert len(rows) == 2 * len(urls)
    assert all((r.host, r.path, r.rule, r.verdict) == judge(r.url) for r in rows)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_vector_search_is_exact_at_factor_one(spark, shard_rows):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    x[100:200] = x[100]  # ties: a third of all rows are one vector
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(400, None, "s"), (401, [], "s"), (402, [0.0] * 6, "s"), (403, [float("nan")] * 6, "s"), (404, [1.0, None, 0.0, 0.0, 0.0, 0.0], "s"), (405, [1.0, 2.0], "s"), (500, [3.0, 4.0], "s"), (None, [1.0] * 6, "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in nearest(df, df.where("vec_id % 25 = 0"), 10, shard_rows=shard_rows).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    v = x.astype(np.float64)
    assert set(got) == set(range(0, 300, 25)) | {500}
    for q in range(0, 300, 25):
        d = np.sqrt(np.add.accumulate((v - v[q]) ** 2, axis=1)[:, -1])
        order = [int(i) for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        assert [got[q][k] for k in range(1, 11)] == [(i, d[i]) for i in order]
    assert list(got[500].values()) == [(405, np.sqrt(8.0))]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_far_cells_are_left_out():
    rng = np.random.default_rng(4)
    homes = 100 * rng.normal(size=(40, 5))
    points = [(homes[i % 40] + rng.normal(size=5)).tolist() for i in range(4000)]
    cells = vector_search.Cells(points[:400], 40)
    for v in points:
        cell, far = cells.deal(np.array(v))
        old = cells.known.get((5, cell), (0.0, 0, 1))
        cells.known[5, cell] = (max(old[0], far), old[1] + 1, 1)
    x, opened = np.array(points), []
    for q in points[::100]:
        tau = np.sort(np.linalg.norm(x - np.array(q), axis=1))[10]
        within = cells.within(np.array(q), tau, 1.0)
        assert {cells.deal(v)[0] for v in x[np.linalg.norm(x - np.array(q), axis=1) <= tau]} <= set(within)
        opened.append(len(within) / len(cells.known))
    assert np.mean(opened) < 0.2


def test_relaxed_search_keeps_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    ask = e.where("vec_id % 20 = 0")
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    exact = pairs(nearest(e, ask, 10))
    assert len(exact & pairs(nearest(e, ask, 10, relax=1.2))) >= 0.9 * len(exact)


def test_quality_on_held_out_rows(spark):
    rows = queries.op3_quality_classifier(spark, SF).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([s >= 0.7 for s in good]) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "fine words here", "q"), (2, None, "q"), (None, "", "q")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).count() == 3 and quality.keep_good(docs, model, 0.0).count() == 3
    none = quality.train(docs, labels.limit(0))
    assert none == (None, 0.5) and {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_risk_gradients_match_finite_differences():
    rng = np.random.default_rng(2)
    draw = lambda n, shift: (rng.normal(shift, 1, (n, quality.N_FEATURES)).astype(np.float32), rng.integers(0, 256, (n, quality.BUCKETS // 8), dtype=np.uint8))
    positive, unlabelled, p = draw(30, 0.5), draw(50, 0.0), quality.PuLearning(hidden=3)
    for prior, steps in ((0.4, 0), (0.95, 150)):  # the second time the negatives' risk falls below zero
        adam = quality.Adam(quality.Model.new(unlabelled[0], p))
        adam.model.weights[4] = rng.normal(0, 0.1, quality.BUCKETS)

        def parts(model=adam.model, prior=prior):
            zp, zu = model.forward(*positive)[0], model.forward(*unlabelled)[0]
            return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

        def own(model=adam.model):
            loss, grads = quality.unlabelled_risk(model, *unlabelled)
            return loss / 50, [g / 50 for g in grads]

        for _ in range(steps):
            adam.step(quality.risk_gradients(adam.model, positive, own(), prior), 0.05)
            if parts()[1] < 0:
                break
        below = parts()[1] < 0
        assert below == (steps > 0)
        grads = quality.risk_gradients(adam.model, positive, own(), prior)
        for i, at in ((0, (5, 1)), (1, (2,)), (2, (0,)), (3, (0,)), (4, (77,))):
            w, old, ends = adam.model.weights[i], adam.model.weights[i][at], []
            for h in (1e-5, -1e-5):
                w[at] = old + h
                good, bad = parts()
                ends.append(-bad if below else good + bad)
            w[at] = old
            assert grads[i][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-6)


def test_prior_comes_from_positives_and_unlabelled_texts():
    rng = np.random.default_rng(3)
    for prior in (0.2, 0.5, 0.9):
        good = rng.beta(6, 2, 20_000)
        rest = np.where(rng.random(60_000) < prior, rng.beta(6, 2, 60_000), rng.beta(2, 6, 60_000))
        counts = [np.histogram(x, quality.BINS, (0, 1))[0].astype(float) for x in (good, rest)]
        assert quality.class_prior(*counts) == pytest.approx(prior, abs=0.05)


def test_rejected_junk_needs_no_bad_labels(spark):
    rng = np.random.default_rng(5)
    plain = lambda: " ".join(rng.choice(["the", "house", "stood", "by", "a", "quiet", "river", "and", "people", "walked", "there"], 60)).capitalize() + "."
    junk = lambda: " ".join("".join(chr(rng.integers(33, 64)) for _ in range(9)) for _ in range(40))
    docs = spark.createDataFrame([(i, plain() if i % 2 else junk(), 1) for i in range(400)], "doc_id long, text string, bits int")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 300, 2)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model[1] == pytest.approx(0.5, abs=0.2)
    kept = {r.doc_id for r in quality.keep_good(docs, model, 0.5).collect()}
    assert np.mean([i % 2 == 1 for i in kept]) > 0.97 and len(kept) > 180


def test_shares_match_plain_em():
    rng = np.random.default_rng(7)
    logp = np.log(rng.dirichlet(np.full(50, 0.4), 3))
    n = np.bincount(np.concatenate([rng.choice(50, 900, p=np.exp(logp[0])), rng.choice(50, 600, p=np.exp(logp[2]))]), minlength=50)
    at = np.flatnonzero(n)
    who, share = language_id.proportions(logp, at, n[at], language_id.Mixture(rounds=400))

    def plain(langs):
        w = [1 / len(langs)] * len(langs)
        for _ in range(400):
            total = [0.0] * len(langs)
            for b in at:
                parts = [x * np.exp(logp[g, b]) for x, g in zip(w, langs, strict=True)]
                for i, x in enumerate(parts):
                    total[i] += n[b] * x / sum(parts)
            w = [x / n.sum() for x in total]
        like = sum(n[b] * np.log(sum(x * np.exp(logp[g, b]) for x, g in zip(w, langs, strict=True))) for b in at)
        return like - 6.0 * np.log(n.sum()) / 2 * len(langs), dict(zip(langs, w, strict=True))

    sets = [[0], [1], [2], [0, 1], [0, 2], [1, 2], [0, 1, 2]]
    best = max((plain(s) for s in sets), key=lambda x: x[0])[1]
    got = dict(zip(who.tolist(), share.tolist(), strict=True))
    assert set(got) == set(best) == {0, 2} and all(got[k] == pytest.approx(best[k], abs=1e-3) for k in best)


def test_long_texts_count_whole(spark):
    text = "the cat and the dog " * 2000 + "le chat et le chien " * 9000
    docs = spark.createDataFrame([(1, "the cat and the dog sat " * 9, "en"), (2, "le chat et le chien est la " * 9, "fr"), (3, text, None)], "doc_id long, text string, lang string")
    row = language_id.predict(docs, language_id.train(docs)).where("doc_id = 3").first()
    assert row.lang_pred == "fr" and len(row.languages) == 2


def test_language_on_held_out_rows(spark):
    rows = queries.op10_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog sat on the mat " * 5, "en"), (2, "le chat et le chien sont sur la table " * 5, "fr"), (3, None, "en"), (4, "123 !!", None), (5, "", "fr"), (None, "the dog and the cat", "en"), (6, "é", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "fr" and got[None].lang_pred == "en"
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[6].lang_pred in ("en", "fr")
    mixed = docs.where("doc_id in (1, 2)").agg(F.lit(9).cast("long").alias("doc_id"), F.concat_ws(" ", F.collect_list("text")).alias("text"))
    assert len(language_id.predict(mixed, model).first().languages) == 2
    none = language_id.train(docs.limit(0))
    assert none[0] == [] and language_id.predict(docs, none).where("lang_pred = 'und'").count() == 7
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_query_columns(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = queries.op6_decontamination(spark, SF)
    assert rows.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] and rows.count() == n


def test_relatives_do_not_push_out_a_second_language():
    rng = np.random.default_rng(6)
    main, other = rng.dirichlet(np.full(400, 0.3), 2)
    tables = [main, *[0.9 * main + 0.1 * rng.dirichlet(np.full(400, 0.3)) for _ in range(10)], other]
    logp = np.log(np.array(tables) + 1e-9)
    n = np.bincount(np.concatenate([rng.choice(400, 3500, p=main), rng.choice(400, 1500, p=other)]), minlength=400)
    at = np.flatnonzero(n)
    assert 11 not in np.argsort(-(logp[:, at] @ n[at]))[:8]
    who, share = language_id.proportions(logp, at, n[at], language_id.Mixture())
    found = dict(zip(who.tolist(), share.tolist(), strict=True))
    assert set(found) == {0, 11} and abs(found[11] - 0.3) < 0.05
