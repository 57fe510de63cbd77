"""MinHash near-dedup, line dedup and repeated passages against brute force."""

from itertools import combinations

import numpy as np
import pytest

from sievestone.llm import line_dedup as lines
from sievestone.llm import minhash_dedup as near
from sievestone.llm import nearness
from sievestone.llm import substring_dedup as passages
from sievestone.llm.common import Scratch, connected_components
from sievestone.llm.nearness import Banding, estimate

SCHEMA = "doc_id long, text string, n long, node string, component string"


def words(rng, n):
    return [f"w{rng.integers(0, 5000)}" for _ in range(n)]


def table(spark, texts):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in texts], SCHEMA)


def mutated(rng, base, k):
    out = list(base)
    for i in rng.choice(len(out), k, replace=False):
        out[i] = f"m{rng.integers(0, 10**9)}"
    return out


def components_of(sets, percent):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("limit", [8, 1024])
def test_components_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(nearness, "LIMIT", limit)  # 8: buckets are dealt into blocks and banded anew
    rng = np.random.default_rng(5)
    base = words(rng, 120)
    texts = [(i, " ".join(mutated(rng, base, int(k)))) for i, k in enumerate(rng.integers(0, 14, 60))]
    texts += [(100 + i, " ".join(words(rng, int(n)))) for i, n in enumerate(rng.integers(1, 60, 20))]
    texts += [(200, texts[3][1]), (201, texts[3][1].upper()), (300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "ONE"), (305, "a b c d e f"), (306, "a b c d e f g"), (307, " ".join(words(rng, 30_000)))]
    p = near.NearDedup(words=2)
    got = {r.doc_id: r for r in near.minhash_dedup(table(spark, texts), p).collect()}
    sets = {i: near.shingles(t, 2) for i, t in texts}
    want = components_of(sets, 80)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert got[304].component_id == 303 and got[301].component_id == 301


def test_near_dedup_edges(spark):
    empty = table(spark, []).limit(0)
    assert near.minhash_dedup(empty).count() == 0
    assert near.keep_one(empty).columns == empty.columns
    odd = table(spark, [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A B C D E")])
    rows = sorted(near.minhash_dedup(odd).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in rows] == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    assert sorted(r.doc_id or 0 for r in near.keep_one(odd).collect()) == [0, 1, 1]


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    p = Banding()
    make = p.sketcher()
    for s in (0.5, 0.8, 0.95):
        n = 2000
        both = int(round(2 * n * s / (1 + s)))
        common = rng.integers(0, 1 << 32, both, dtype=np.uint64).astype(np.uint32)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 32, n - both, dtype=np.uint64).astype(np.uint32)]) for _ in range(2))
        x, y = make(np.concatenate([a, b]), np.array([len(a), len(b)]))[1].view(np.uint64)
        nibbles = lambda v: (v[:, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4)) & np.uint64(15)).ravel()
        assert estimate(int((nibbles(x) == nibbles(y)).sum()), 160) == pytest.approx(s, abs=0.12)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_lines_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = " ".join(words(rng, 30))
    texts = []
    for i in range(25):
        own = [" ".join(words(rng, int(rng.integers(1, 20)))) for _ in range(3)]
        own.insert(1, base[:-1] + str(i % 7) if i % 2 else base.upper())
        texts.append((i, "\n".join([*own, "", "  "])))
    alone = " ".join(words(rng, 12))
    texts += [(50, None), (51, ""), (52, "\n\n"), (None, base), (None, alone), (3, f"{alone}\n{base}"), (3, None), (60, "ab\nab\nxy")]
    df = table(spark, texts)
    rank = {t: k for k, t in enumerate(sorted({(i is None, i or 0) for i, _ in texts}))}
    order = lambda i, k: (rank[(i is None, i or 0)], k)
    distinct, first = {}, {}
    for i, t in texts:
        for k, line in enumerate((t or "").split("\n")):
            if line := lines.normal(line):
                distinct.setdefault(line, lines.shingles(line, 5))
                first[line] = min(first.get(line, (99, 0, i)), (*order(i, k), i))
    names = dict(enumerate(distinct))
    parts = components_of({n: distinct[line] for n, line in names.items()}, 80)
    best = {}
    for n, line in names.items():
        best[parts[n]] = min(best.get(parts[n], (99, 0, 0)), first[line])
    where = {line: best[parts[n]] for n, line in names.items()}
    want = [(i, k, where[n][2], where[n][1]) for i, t in texts for k, line in enumerate((t or "").split("\n")) if (n := lines.normal(line))]
    rows = lines.line_classes(df).collect()
    assert sorted(((r.doc_id, r.line, r.class_doc_id, r.class_line) for r in rows), key=str) == sorted(want, key=str)
    assert sum(r.kept for r in rows) == len(best)
    done = lines.dedup_lines(df.withColumnRenamed("component", "row_key").withColumnRenamed("n", "gone")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in done if r.doc_id in (50, 52, None, 3, 60) and r.text != texts[3][1]) == sorted(
        str(x) for x in [(50, None), (52, "\n\n"), (None, ""), (None, ""), (3, alone), (3, None), (60, "ab\nxy")] + [(3, r.text) for r in done if r.doc_id == 3 and r.text and r.text != alone]
    )
    by_id = {r.doc_id: r.text for r in done}
    assert by_id[0] == texts[0][1] and len(by_id[2].split("\n")) == len(texts[2][1].split("\n")) - 1
    assert lines.line_classes(df.limit(0)).count() == 0 and lines.dedup_lines(df).columns == df.columns


def test_passages_are_found_wherever_they_stand(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(words(rng, 60))
    texts = [(i, " ".join(words(rng, 50)) + "\n" + " ".join(words(rng, 20))) for i in range(20)]
    for i in (4, 9, 15):
        w = texts[i][1].split(" ")
        texts[i] = (i, " ".join([*w[: i + 3], passage, *w[i + 3 :]]))
    texts += [(30, None), (31, ""), (None, passage), (32, "the " * 400), (33, "é " + texts[0][1])]
    df = table(spark, texts)
    rows = passages.repeated_passages(df).collect()
    assert {r.doc_id for r in rows} == {9, 15, 32, 33, None}  # ids that are null come last
    text = dict(texts)
    for r in rows:
        if r.doc_id in (9, 15):
            assert text[r.doc_id][r.start : r.start + r.length] in passage and r.n_words >= 25 and r.first_doc_id == 4
    done = {r.doc_id: r.text for r in passages.remove_passages(df.withColumnRenamed("n", "spans").withColumnRenamed("node", "row_key")).collect()}
    assert done[4] == text[4] and done[30] is None and len(done[9]) < len(text[9]) and done[33].startswith("é") and len(done[None]) < 100
    assert passages.repeated_passages(df.limit(0)).count() == 0 and passages.remove_passages(df).columns == df.columns


def test_short_lines_match_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(words(rng, n)) for n in range(1, 20)] + ["go " * 12 + "go"]
    middle = " ".join(words(rng, 8))
    texts = []
    for i in range(40):
        own = [" ".join(words(rng, 30)) + f" end{i}" for _ in range(3)] + ["é go"]
        own[1] = f"{own[1]} {middle} {own[0][:40]}"  # part of a line, too short to go
        at = rng.choice(len(pool), 4)
        texts.append((i, "\n".join(x for k, line in zip(at, own, strict=True) for x in (line, f"  {pool[k].upper() if i % 3 else pool[k]} ", ""))))
    seen, want = {}, set()
    for i, t in texts:
        start, kept = 0, []
        for line in t.split("\n"):
            normal = " ".join(line.lower().split())
            if normal:
                kept.append((normal in seen, start + len(line) - len(line.lstrip()), start + len(line.rstrip()), len(normal.split()), seen.setdefault(normal, i)))
            start += len(line) + 1
        run = []
        for x in [*kept, (False,)]:  # neighbouring lines are one passage
            if x[0]:
                run.append(x)
            elif run:
                want.add((i, run[0][1], run[-1][2] - run[0][1], sum(r[3] for r in run), run[0][4]))
                run = []
    got = passages.repeated_passages(table(spark, texts)).collect()
    assert {(r.doc_id, r.start, r.length, r.n_words, r.first_doc_id) for r in got} == want and len(got) == len(want)
    assert {n for _, _, _, n, _ in want} >= {1, 2, 8, 13, 19}
    done = {r.doc_id: r.text for r in passages.remove_passages(table(spark, texts)).collect()}
    assert all(len(done[i]) == len(t) - sum(w[2] for w in want if w[0] == i) for i, t in texts)


def test_removal_judges_every_row_by_its_own_text(spark):
    rng = np.random.default_rng(9)
    a, b, c = (" ".join(words(rng, 30)) for _ in range(3))
    rows = [(1, a), (2, f"{a} {b}"), (2, c), (None, f"{c} {a}"), (None, " ".join(words(rng, 8))), (None, None)]
    got = passages.remove_passages(table(spark, rows)).collect()
    left = sorted((str(r.doc_id), len(r.text or "")) for r in got)
    assert ("1", len(a)) in left and ("2", len(c)) in left and len(got) == len(rows)
    assert [r.text for r in got if r.doc_id == 2 and r.text != c][0].strip().endswith(b[-20:])
    gone = near.keep_one(table(spark, [(1, a), (2, a), (2, c), (3, c)]), near.NearDedup()).collect()
    assert sorted((r.doc_id, r.text) for r in gone) == sorted([(1, a), (2, c)])
