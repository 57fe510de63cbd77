"""Findings of reviews on corpus operators: each test fails on the code before its mend."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

from sievestone.llm import line_dedup, nearness, tokens
from sievestone.llm.common import Scratch


def test_links_of_a_crowded_bucket_are_those_of_a_small_one(spark, monkeypatch):
    rng, p = np.random.default_rng(11), nearness.Banding()
    sets = []
    for _ in range(300):  # pairs of similarity 36 / 44
        base = rng.integers(0, 1 << 32, 44, dtype=np.uint64).astype(np.uint32)
        sets += [np.sort(base[:40]), np.sort(base[4:])]
    _, sig = p.sketcher()(np.concatenate(sets), np.array([len(s) for s in sets]))
    sigs = spark.createDataFrame([(i, len(s), [int(x) for x in g]) for i, (s, g) in enumerate(zip(sets, sig, strict=True))], "node long, n int, sig array<long>")
    texts = spark.createDataFrame([(i, " ".join(map(str, s.tolist()))) for i, s in enumerate(sets)], "node long, text string")
    members = sigs.selectExpr("1l as key", "node")
    found = []
    for limit in (1024, 64):
        monkeypatch.setattr(nearness, "LIMIT", limit)
        pairs = nearness._across(members, members.limit(0).selectExpr("node", "node as component"), sigs, lambda nodes: texts.join(nodes, "node"), lambda t: np.array(t.split(), np.uint32), p, Scratch(spark, f"crowded-{limit}"))
        found.append({(r["a"], r["b"]) for r in pairs.collect()})
    assert found[0] == found[1] and len(found[0]) > 290


def test_white_space_is_told_without_an_expression_over_the_text():
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice(" \n\t\r\x0b\x1c\x85\xa0 　abé" if rng.random() < 0.2 else " \nabé") for _ in range(rng.randrange(9)))
        assert tokens.spaced(text, " \n\t\r") == (not re.search(r"[^\S \n\t\r]", text))
        assert tokens.single(text) == (not re.search(r"\s\s|[^\S \n]", text))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_pieces_take_no_expression(name, monkeypatch):
    own = tokens.Encoder(public_tokenizers.path(name))
    texts = ["Some words, and (more) of them.\nAnother_line! ends; here...", "A don't, it's -- 3 times x9 #tag"]
    assert all(own.ids(t).tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)
    own = tokens.Encoder(public_tokenizers.path(name))
    for pattern in ("WORD", "WORD_AND_MARKS"):
        monkeypatch.setattr(tokens, pattern, None)
    text = "Some words and more of them"
    assert own.ids(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_links_of_many_small_groups_and_of_a_large_one_are_the_plain_ones():
    rng = np.random.default_rng(5)

    def sets_of(n):
        base = rng.integers(0, 1 << 32, 120, dtype=np.uint64).astype(np.uint32)
        return [np.unique(np.concatenate([base[: rng.integers(95, 121)], rng.integers(0, 1 << 32, 5, dtype=np.uint64).astype(np.uint32)])) for _ in range(n)]

    def pairs(a, b):
        return sorted((min(x, y), max(x, y)) for x, y in zip(a, b, strict=True))

    groups = [(np.full(n, 2) if n % 2 else rng.integers(0, 2, n), rng.integers(-9, 1 << 40, n), rng.integers(0, 4, n), sets_of(n)) for n in rng.integers(2, 12, 60)]
    apart = [p for g in groups for p in pairs(*nearness.linked_parts(*g, 80))]
    whole = [np.concatenate([g[k] for g in groups]) for k in range(3)], [s for g in groups for s in g[3]]
    at = np.repeat(np.arange(60), [len(g[3]) for g in groups])
    assert pairs(*nearness.linked_in_small_groups(at, *whole[0], whole[1], 80)) == sorted(apart) != []
    side, node, part, sets = np.full(70, 2), np.arange(70), np.arange(70) // 2, sets_of(70)
    i, j = np.meshgrid(node, node)
    near = {(a, b) for a, b in zip(i.ravel(), j.ravel(), strict=True) if part[a] != part[b] and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(*nearness.linked_parts(side, node, part, sets, 80), strict=True)) <= near != set()


def test_runs_of_a_line_are_its_set():
    rng = random.Random(3)
    for _ in range(300):
        x, y = ("".join(rng.choice("abcé " if rng.random() < 0.99 else "中😀") for _ in range(rng.randrange(40))) for _ in range(2))
        s, t = line_dedup.shingles(x, 5), line_dedup.shingles(y, 5)
        assert (len(line_dedup.Runs(x, 5)), len(line_dedup.Runs(x, 5) & line_dedup.Runs(y, 5))) == (len(s), len(s & t))
