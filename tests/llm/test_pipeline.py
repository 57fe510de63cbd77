"""Stages of the pipeline against plain versions, and what they do with odd rows."""

from itertools import combinations

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sievestone.llm import decontamination as decon
from sievestone.llm import line_dedup as lines
from sievestone.llm import minhash_dedup as near
from sievestone.llm import quality
from sievestone.llm.queries import quality_model

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


def pairs_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def linked(sets, percent=80):
    """The smallest member of each set's component."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def odd_rows():
    """Copies, near copies, texts that share lines, nulls, empties, repeated and null ids, a very long text."""
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{rng.integers(0, 4000)}" for _ in range(n))
    a, b, c = (text(60) for _ in range(3))
    rows = [(1, a), (2, a), (3, a + " end"), (4, f"{b}\n{c}"), (5, f"{text(30)}\n{b}"), (6, None), (7, ""), (8, " \n\n"), (9, text(30_000)), (9, c), (10, text(12)), (10, text(12)), (None, b), (None, text(40)), (None, None), (11, "\n".join(text(9) for _ in range(300)))]
    return rows + [(20 + i, a.replace(f"w{i}", "x") + f" tail {i}") for i in range(4)]


def test_line_stage_matches_plain_version(spark):
    rows = odd_rows()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    found = [(k, i, n) for k in order for i, line in enumerate((rows[k][1] or "").split("\n")) if (n := lines.normal(line))]
    first = {}
    for place, (_, _, n) in enumerate(found):
        first.setdefault(n, place)
    names = list(first)
    best = {}
    for n, c in zip(names, linked([lines.shingles(n, 5) for n in names]), strict=True):
        best[c] = min(best.get(c, 1 << 60), first[n])
    kept = {(k, i) for p, (k, i, _) in enumerate(found) if p in set(best.values())}
    want = []
    for k, (doc, t) in enumerate(rows):
        left = t and "\n".join(x for i, x in enumerate(t.split("\n")) if not lines.normal(x) or (k, i) in kept)
        if not (t and t.strip() and not left.strip()):
            want.append((doc, left))
    got = corpus_pipeline.line_dedup(spark, table(spark, rows), SF)
    assert pairs_of(got) == sorted(want, key=str)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got.collect())


def test_near_stage_matches_plain_version(spark):
    rows = odd_rows()
    ranked = sorted((k for k, (i, t) in enumerate(rows) if i is not None and near.words_of(t)), key=lambda k: (rows[k][0], k))
    heads = linked([near.shingles(rows[k][1], 5) for k in ranked])
    gone = {k for k, h in zip(ranked, heads, strict=True) if rows[k][0] != rows[ranked[h]][0]}
    assert pairs_of(corpus_pipeline.near_dedup(spark, table(spark, rows), SF)) == sorted((x for k, x in enumerate(rows) if k not in gone), key=str) and len(gone) >= 3


def test_decontamination_stage_matches_plain_version(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 120").first().text
    rows = [*odd_rows(), (9, f"before {item} after"), (None, item), (30, item.upper())]
    windows = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in decon.windows_of(r.text, 10)}
    hit = lambda t: any(b" ".join((w := decon.words_of(t))[i : i + n]) in windows for n in {x.count(b" ") + 1 for x in windows} for i in range(len(decon.words_of(t)) - n + 1))
    short = [x for x in rows if len(x[1] or "") < 50_000]  # the plain version is too slow for the long text, which has no window
    want = [x for x in short if not hit(x[1])] + [x for x in rows if len(x[1] or "") >= 50_000]
    got = pairs_of(corpus_pipeline.decontamination(spark, table(spark, rows), SF))
    assert got == sorted(want, key=str) and len(got) == len(rows) - 3


def test_quality_stage_keeps_what_scores_well(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = quality.score(docs, quality_model(spark, docs, SF)).collect()
    kept = [r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, SF).collect()]
    assert sorted(kept) == sorted(r.doc_id for r in scores if r.score >= 0.7) and 0 < len(kept) < len(scores)


def test_packing_stage_holds_every_token(spark):
    rows = [x for x in odd_rows() if len(x[1] or "") < 50_000]
    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.packing(spark, table(spark, rows), SF).collect()
    assert sum(p.length for p in pieces) == sum(len(fresh.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


def test_stages_on_empty_tables_and_clashing_columns(spark):
    rows = table(spark, odd_rows()[:8])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), SF).count() == 0
        if name != "packing":
            wide = rows
            for c in ("row_key", "gone", "spans", "node", "hit_id", "text_key"):
                wide = wide.withColumn(c, rows.doc_id)
            out = stage(spark, wide, SF)
            assert out.columns == wide.columns and out.count() <= 8


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    pieces = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(pieces) == before and all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def test_copies_with_blank_lines_go(spark):
    text = "the first paragraph of a text\n\nand here the second one\n\t\n \nthen a third"
    rows = [(1, text), (2, text), (3, "\n\n"), (4, " \n\t"), (5, None)]
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, table(spark, rows), SF).collect()}
    assert kept == {1: text, 3: "\n\n", 4: " \n\t", 5: None}
