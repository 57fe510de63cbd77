"""Toxicity: the automaton against plain distances, contexts, learning of terms, and held-out labels."""

import random
import string

import pytest

from sievestone.llm import queries
from sievestone.llm import toxicity as tx

TERMS = [("idiot", False), ("moron", False), ("worthless", False), ("disgusting", False), ("vequ", True), ("abominable", True), ("ugh", False)]


def distance(a, b):
    """Letters added, left out, changed, or two neighbours exchanged and not touched again."""
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def plain(word):
    found = []
    for i, (term, stem) in enumerate(TERMS):
        e = min(distance(term, word[:k]) for k in range(len(word) + 1)) if stem else distance(term, word)
        if e <= tx.errors_allowed(term, stem):
            found.append((e, -len(term), i))
    return (min(found)[2], min(found)[0]) if found else None


@pytest.mark.parametrize("seed", range(8))
def test_automaton_finds_what_plain_distances_find(seed):
    rng = random.Random(seed)
    matcher = tx.Matcher(TERMS, most_states=300)
    for _ in range(600):
        word = list(rng.choice(TERMS)[0])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(word) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                word.insert(k, rng.choice(string.ascii_lowercase))
            elif word and kind == 1:
                del word[min(k, len(word) - 1)]
            elif word and kind == 2:
                word[min(k, len(word) - 1)] = rng.choice(string.ascii_lowercase)
            elif len(word) > 1:
                k = min(k, len(word) - 2)
                word[k], word[k + 1] = word[k + 1], word[k]
        word = "".join(word) + rng.choice(["", "", "xyz"])
        assert matcher.find(word) == plain(word), word


def test_words_are_folded():
    assert [tx.fold(w) for w in ("Idiot!", "1d10t", "m0r0n.", "$tupid", "s.c.u.m", "—", "42", "", "Ｉｄｉｏｔ", "¡réeux!")] == ["idiot", "idiot", "moron", "stupid", "scum", "", "", "", "idiot", "réeux"]
    assert tx.spelt_out("you i d i o t a b c".split()) == ["you", "idiotabc"]
    assert tx.spelt_out("a b c d".split()) == ["abcd"] and tx.spelt_out("a b".split()) == ["a", "b"]


def test_quotation_is_told_from_abuse():
    at = lambda text, word: tx.is_quoted(text.split(), next(i for i, t in enumerate(text.split()) if word in t), 6)
    assert at('He read "what an idiot he is" aloud', "idiot")
    assert at("the word idiot comes from Greek", "idiot") and at("das Wort Idiot kommt", "Idiot")
    assert not at("you are an idiot and I said so", "idiot") and not at("what an idiot", "idiot")
    assert not at('"hello" far away from here there is one more of those idiot things', "idiot")


def test_terms_are_words_or_stems():
    chosen = tx.choose_terms([("tras", True, 99.0), ("trash", False, 98.0), ("trashy", False, 1.0), ("ré", True, 10.0), ("réeux", True, 50.0), ("réeuxpa", False, 20.0), ("réê", True, 30.0)], 10)
    assert chosen == [("trash", False), ("réeux", True), ("réê", True), ("trashy", False)]


def corpus(n=400):
    rng = random.Random(3)
    words = ["".join(rng.choice(["ta", "lo", "mi", "ner", "sa", "du"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["grunkle", "vashtop", "snorf" + rng.choice(words)]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_lexicon_misspellings_and_odd_rows(spark):
    rows = corpus()
    extra = [(1000, "lo mi grunkel sa vasht0p du", None), (1001, None, None), (1002, "", None), (None, "grunkle vashtop", None), (1003, "ta lo " * 20_000, None), (1003, "grunkle vashtop ta", None), (1004, "x", None)]
    docs = spark.createDataFrame([(i, t, "a") for i, t, _ in rows + extra], "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1004, None)], "doc_id long, toxic int")
    got = [(r.doc_id, r.score) for r in tx.score_toxicity(docs, labels).collect()]
    assert len(got) == len(rows) + len(extra)
    score = dict(got[:])
    assert all((score[i] >= 0.7) == bool(y) for i, _, y in rows)
    assert score[1000] >= 0.7 and score[1001] == score[1002] < 0.1 and score[None] >= 0.7
    assert sorted(s >= 0.7 for i, s in got if i == 1003) == [False, True]
    none = labels.where("toxic = 0")
    assert {r.score for r in tx.score_toxicity(docs, none).collect()} == {0.0}
    assert {r.score for r in tx.score_toxicity(docs, none.where("toxic = 1")).collect()} == {0.5}
    assert tx.score_toxicity(docs.where("doc_id > 5000"), labels).collect() == []
    seeded = {r.doc_id: r.score for r in tx.score_toxicity(docs.where("doc_id = 1000"), labels, seeds={"Grunkle": 500.0}).collect()}
    assert len(seeded) == 1


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op11_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[d].score, y, rows[d].predicted) for d, y in labels.items() if rows[d].held_out]
    assert all(0 <= s <= 1 and p == (s >= 0.7) for s, _, p in held)
    bad, fine = [p for _, y, p in held if y == 1], [p for _, y, p in held if y == 0]
    assert sum(bad) >= 0.88 * len(bad) and sum(fine) <= 0.01 * len(fine)  # a tenth of the toxic marks are on texts without such words
