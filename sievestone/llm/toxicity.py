"""Toxicity scores: a lexicon learnt from labels, matched through misspellings, in context.

- The lexicon holds words, and stems that words start with, that occur far more
  often in texts labelled toxic than in others. It comes from counts of all
  labelled rows, near copies counting once; likelihood ratios decide, against
  as many candidates as there are.
- The terms form a trie. Levenshtein automata of all of them run over it at
  once: a state is the set of places in the trie that a prefix of a word can
  stand for, with the errors spent, and states are made when first reached.
- A hit is set apart from abuse if it stands between quotation marks, or next to
  a word of mention and without one of address in its window.
- Counts of hits by term, errors and context are weighed by how often each
  occurs in toxic and other texts; a logistic regression turns a document's
  evidence, and how unlikely that many hits are by chance in so many words,
  into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, own_columns, slices, small_batches, small_side
from .minhash_dedup import shingle_hashes, words_of

#: Fixed values. Signs that stand for letters inside words.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
#: Fixed values. Quotation marks that open and close.
OPENING, CLOSING = "\"“„«‘'`", "\"”“»’'`"
#: Fixed values. Words of mention, and of address, in English, Spanish, French and German.
MENTION = frozenset("word words term terms said says say saying called calls wrote writes quote quoted quotes means meaning insult insults slur palabra palabras dijo dice llamó escribió insulto término mot mots dit disait écrit appelé insulte terme wort wörter sagte sagt schrieb nannte beleidigung begriff".split())
ADDRESS = frozenset("you you're your yours u ur tú usted eres tu te vous toi t'es votre du dich dir sie ihr euch bist".split())


@dataclass(frozen=True)
class Toxicity:
    """``terms``: most terms of the lexicon. ``stem``: fewest and most letters of a stem. ``ratio``: how many times as often a term must occur in toxic texts. ``window``: words on either side that decide a hit's context. ``spread``: buckets of unlike toxic texts, of 64, that a term must occur in."""

    terms: int = 5000
    stem: tuple[int, int] = (3, 12)
    ratio: float = 8.0
    window: int = 6
    spread: int = 3
    discount: tuple[float, ...] = (1.0, 0.8, 0.5)
    quoted: float = 0.25
    steadiness: float = 5.0


def fold(token: str) -> str:
    """A word in lower case, with look-alike signs as letters and other signs dropped; nothing if it has no letter."""
    low = token.lower()
    if low.isalpha():
        return low if low.isascii() else unicodedata.normalize("NFKC", low)
    low = unicodedata.normalize("NFKC", low).strip("\"'“”„«»‘’`.,;:!?()[]{}<>*_-#%&+=~^/\\|…")
    if low.isalpha():
        return low
    if not any(c.isalpha() for c in low):
        return ""
    return "".join(c for c in low.translate(LOOK_ALIKE) if c.isalpha())


def errors_allowed(term: str, stem: bool) -> int:
    """Misspellings of short words would be other words, and those of stems other words' beginnings."""
    n = len(term)
    return (n >= 8) if stem else (n >= 4) + (n >= 8)


class Matcher:
    """Finds the term nearest to a word: fewest errors (letters added, left out, changed, or two neighbours exchanged), then longest, then first.

    The automaton is deterministic; its states are made when they are first
    reached, and all are forgotten when there are too many.
    """

    def __init__(self, terms: list[tuple[str, bool]], most_states: int = 20_000):
        self.terms, self.most_states = terms, most_states
        self.next: list[dict[str, int]] = [{}]
        self.word_at: list[int] = [-1]
        self.stem_at: list[int] = [-1]
        self.errors = [0]  # most errors that any term below a node allows
        for i, (text, stem) in enumerate(terms):
            node, allowed = 0, errors_allowed(text, stem)
            self.errors[0] = max(self.errors[0], allowed)
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word_at.append(-1)
                    self.stem_at.append(-1)
                    self.errors.append(0)
                node = self.next[node][c]
                self.errors[node] = max(self.errors[node], allowed)
            at = self.stem_at if stem else self.word_at
            at[node] = i if at[node] < 0 else at[node]
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._state(self._closed({(0, "", -1): 0}))

    def _closed(self, places: dict[tuple[int, str, int], int]) -> frozenset:
        """With the places reached by leaving out letters of terms; stems that are complete stay so whatever follows.

        A place is a node, a letter of the term that an exchange has passed
        over, and a complete stem, with the fewest errors that lead there.
        """
        out: dict[tuple[int, str, int], int] = {}
        held = list(places.items())
        while held:
            place, e = held.pop()
            node, skipped, stem = place
            if e > (errors_allowed(self.terms[stem][0], True) if stem >= 0 else self.errors[node]) or out.get(place, 9) <= e:
                continue
            out[place] = e
            if stem < 0 and not skipped:
                if self.stem_at[node] >= 0:
                    held.append(((0, "", self.stem_at[node]), e))
                held.extend(((child, "", -1), e + 1) for child in self.next[node].values())
        return frozenset((*place, e) for place, e in out.items())

    def _state(self, places: frozenset) -> int:
        if places not in self.states:
            self.states[places] = len(self.sets)
            self.sets.append(places)
            self.moves.append({})
            ends = [(e, -len(self.terms[i][0]), i) for node, skipped, stem, e in places for i in ([stem] if stem >= 0 else [self.word_at[node]] if not skipped and self.word_at[node] >= 0 else []) if e <= errors_allowed(*self.terms[i])]
            self.found.append((min(ends)[2], min(ends)[0]) if ends else None)
        return self.states[places]

    def _move(self, state: int, c: str) -> int:
        after: dict[tuple[int, str, int], int] = {}

        def reach(place, e):
            if e < after.get(place, 9):
                after[place] = e

        for node, skipped, stem, e in self.sets[state]:
            if stem >= 0:
                reach((0, "", stem), e)
            elif skipped:
                if c == skipped:  # the second letter of an exchange
                    reach((node, "", -1), e)
            else:
                reach((node, "", -1), e + 1)  # a letter too many
                for letter, child in self.next[node].items():
                    reach((child, "", -1), e + (letter != c))
                    if letter != c and c in self.next[child]:
                        reach((self.next[child][c], letter, -1), e + 1)
        return self._state(self._closed(after))

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, errors), or None."""
        if len(self.sets) > self.most_states:
            self._forget()
        state, moves, sets = self.start, self.moves, self.sets
        for c in word:
            to = moves[state].get(c)
            if to is None:
                to = moves[state][c] = self._move(state, c)
            state = to
            if not sets[state]:
                return None
        return self.found[state]


class _Words(dict):
    """Matches of words as they stand in texts, in two generations."""

    def __init__(self, matcher: Matcher, limit: int = 200_000):
        super().__init__()
        self.matcher, self.limit, self.old = matcher, limit, {}

    def __missing__(self, token: str):
        if token in self.old:
            found = self.old[token]
        else:
            word = fold(token)
            found = self.matcher.find(word) if word else None
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[token] = found
        return found


def is_quoted(tokens: list[str], i: int, window: int) -> bool:
    """Whether the word at ``i`` is mentioned rather than used.

    It is if a quotation mark opens at or before it and one closes at or after
    it, or if a word of mention and none of address stands within the window.
    """
    before, after = tokens[max(0, i - window) : i + 1], tokens[i : i + window + 1]
    opens = any(t[0] in OPENING and len(t) > 1 for t in before)
    closes = any(t.rstrip(".,;:!?")[-1:] in CLOSING and len(t) > 1 for t in after) if opens else False
    if closes:
        return True
    near = {t.lower().strip("\"'“”„«»‘’`.,;:!?()") for t in (*before, *after)}
    return not near.isdisjoint(MENTION) and near.isdisjoint(ADDRESS)


def spelt_out(tokens: list[str]) -> list[str]:
    """With runs of four or more single letters joined to words."""
    out: list[str] = []
    run: list[str] = []
    for t in (*tokens, ""):
        if len(t) == 1 and t.isalpha():
            run.append(t)
            continue
        out.extend(["".join(run)] if len(run) >= 4 else run)
        run = []
        out.append(t)
    return out[:-1]


WORD_COUNTS = "word string, toxic long, other long, spread long"


def _count_words(texts: DataFrame, most: int = 200_000) -> DataFrame:
    """Occurrences of words in toxic and in other texts, at most two a text, and the buckets of toxic texts with it, for (text, toxic).

    A text's bucket is its least word hash, so near copies share one.
    """

    def count(batches):
        held: dict[str, list[int]] = {}

        def flush():
            rows = [list(held), *([x[k] for x in held.values()] for k in range(3))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(r, pa.int64()) for r in rows[1:])], ["word", "toxic", "other", "spread"])

        for batch in slices(batches, 0):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(map(fold, (text or "").split()))
                words.pop("", None)
                if not words:
                    continue
                bucket = min(map(xxhash.xxh32_intdigest, words)) % 64
                bit = (1 << bucket) - ((1 << 64) if bucket == 63 else 0)
                for word, n in words.items():
                    own = held.setdefault(word[:64], [0, 0, 0])
                    own[0 if toxic else 1] += min(n, 2)
                    if toxic:
                        own[2] |= bit
                if len(held) > most:
                    yield flush()
        yield flush()

    partial = texts.mapInArrow(count, WORD_COUNTS)
    return partial.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.expr("bit_or(spread)").alias("spread"))


#: Odd multipliers of the hashes whose minima tell near copies.
MINIMA = np.random.default_rng(5).integers(1, 1 << 62, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _one_of_each(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """key of one text of each group of near copies, of (key, text): those with the least key at each of six minima over runs of five words."""

    def sketch(batches):
        for batch in slices(batches, 1):
            keys, lows = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = shingle_hashes(words_of(text or ""), 5)
                if len(h):
                    keys.append(key)
                    lows.append((h[None, :] * MINIMA[:, None]).min(axis=1).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lows, pa.list_(pa.int64()))], ["key", "lows"])

    minima = scratch.save(texts.mapInArrow(sketch, "key long, lows array<long>").select("key", F.posexplode("lows").alias("k", "low")), "minima")
    first = minima.groupBy("k", "low").agg(F.min("key").alias("first"))
    return minima.join(first, ["k", "low"]).groupBy("key").agg(F.min((F.col("key") == F.col("first")).cast("int")).alias("own")).where("own = 1").select("key")


def choose_terms(candidates: list[tuple[str, bool, float]], most: int) -> list[tuple[str, bool]]:
    """Terms of (text, stem, strength), strongest first, none of which is the beginning of another's stem.

    Where a longer one below has nine tenths of the strength, it is taken
    instead, as misspellings are then judged by the whole word.
    """
    ranked = sorted(candidates, key=lambda x: (-x[2], -len(x[0]), x[1], x[0]))
    below: dict[str, list[tuple[str, bool, float]]] = {}
    for c in ranked:
        for k in range(1, len(c[0]) + 1):
            below.setdefault(c[0][:k], []).append(c)
    stems: set[str] = set()
    beginnings: set[str] = set()
    out: list[tuple[str, bool]] = []
    for text, stem, strength in ranked:
        if len(out) >= most:
            break
        near = [c for c in below[text] if stem and c[2] >= 0.9 * strength] or [(text, stem, strength)]
        text, stem, _ = max(near, key=lambda c: (len(c[0]), not c[1]))
        if any(text[:k] in stems for k in range(1, len(text) + 1)) or stem and text in beginnings or (text, stem) in out:
            continue
        out.append((text, stem))
        if stem:
            stems.add(text)
        beginnings.update(text[:k] for k in range(1, len(text) + 1))
    return out


def learn_terms(texts: DataFrame, scratch: Scratch, p: Toxicity) -> dict[tuple[str, bool], tuple[float, float]]:
    """The lexicon, with each term's rate of occurrences in toxic and in other texts, from (doc_id, text, toxic)."""
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("key"), "text", "toxic")
    own = small_side(scratch.save(_one_of_each(keyed.select("key", "text"), scratch), "own"))
    words = scratch.save(_count_words(keyed.join(own, "key", "left_semi").select("text", "toxic")), "words")
    toxic, other, n = words.agg(F.sum("toxic"), F.sum("other"), F.count("*")).first()
    if not toxic or not other:
        return {}
    least, most = p.stem
    cut = F.explode(F.expr(f"sequence({least}, least({most}, length(word)))")).alias("k")
    stems = words.where(F.length("word") >= least).select("*", cut).groupBy(F.expr("substring(word, 1, k)").alias("text"))
    stems = stems.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.expr("bit_or(spread)").alias("spread"), F.count("*").alias("n")).where("n > 1").drop("n").withColumn("stem", F.lit(True))
    every = stems.unionByName(words.where(F.length("word") >= least).withColumnRenamed("word", "text").withColumn("stem", F.lit(False)))
    own, rest = F.col("toxic") + F.lit(0.5), F.col("other") + F.lit(0.5)
    ratio = own / rest * (other / toxic)
    share = float(toxic) / (toxic + other)
    both = F.col("toxic") + F.col("other")
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    strength = 2 * (term(F.col("toxic"), both * share) + term(F.col("other"), both * (1 - share)))
    found = every.where(F.expr(f"bit_count(spread) >= {p.spread}")).select("text", "stem", "toxic", "other", strength.alias("strength"), ratio.alias("ratio"))
    found = found.where((F.col("ratio") >= p.ratio) & (F.col("strength") >= 2 * math.log(8 * n + 1) + 10)).orderBy(F.col("strength").desc(), "text", "stem").limit(p.terms)
    rows = {(r["text"], r["stem"]): ((r["toxic"] + 0.5) / toxic, (r["other"] + 0.5) / other, r["strength"]) for r in found.collect()}
    scratch.drop("words")
    return {k: rows[k][:2] for k in choose_terms([(*k, v[2]) for k, v in rows.items()], p.terms)}


HITS = "doc_id long, n_words long, hits array<struct<term: int, kind: int, n: int>>"


def _match(docs: DataFrame, terms: list[tuple[str, bool]], p: Toxicity) -> DataFrame:
    """Hits of every whole text by term and kind, twice the errors and one more if quoted."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def match(batches):
        words = _Words(Matcher(held.value))
        kind = pa.list_(pa.struct([("term", pa.int32()), ("kind", pa.int32()), ("n", pa.int32())]))
        for batch in slices(batches, 1):
            sizes, found = [], []
            for text in batch.column(1).to_pylist():
                tokens = (text or "").split()
                if re.search(r"(?<!\S)(?:[^\W\d_]\s){3}[^\W\d_](?!\S)", text or ""):
                    tokens = spelt_out(tokens)
                hits = Counter((m[0], 2 * m[1] + is_quoted(tokens, i, p.window)) for i, t in enumerate(tokens) if (m := words[t]))
                sizes.append(len(tokens))
                found.append([{"term": t, "kind": k, "n": n} for (t, k), n in sorted(hits.items())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "hits"])

    return docs.mapInArrow(match, HITS)


def weights(rates: list[tuple[float, float]], tallies: dict[tuple[int, int], tuple[int, int]], totals: tuple[int, int], p: Toxicity) -> dict[tuple[int, int], float]:
    """Of each term and kind: the logarithm of how much more often it occurs in toxic texts.

    That of an exact hit is the lexicon's; of others a share of it, drawn towards
    what the labelled texts show the more of them there are.
    """
    out = {}
    for term, (toxic, other) in enumerate(rates):
        for kind in range(2 * len(p.discount)):
            guess = math.log(toxic / other) * p.discount[kind // 2] * (p.quoted if kind % 2 else 1.0)
            a, b = tallies.get((term, kind), (0, 0))
            seen = math.log((a + 0.5) / (totals[0] + 1) / ((b + 0.5) / (totals[1] + 1))) if a + b else 0.0
            out[term, kind] = guess if kind == 0 else (guess * p.steadiness + seen * (a + b)) / (p.steadiness + a + b)
    return out


N_EVIDENCE = 8


def evidence(hits: list[tuple[int, int, int]], n_words: int, weight: dict[tuple[int, int], float], chance: list[float]) -> list[float]:
    """Numbers of a document: weighted hits, how unlikely they are by chance in its words, their density, and what is quoted."""
    direct = quoted = best = 0.0
    expected, n, terms = 0.0, 0, set()
    for term, kind, times in hits:
        w = weight.get((term, kind), 0.0)
        if w <= 0:
            continue
        if kind % 2:
            quoted += w * times
            continue
        direct += w * times
        best = max(best, w)
        n += times
        if term not in terms:
            expected += chance[term] * n_words
        terms.add(term)
    surprise = n * math.log(n / expected) - n + expected if n > expected else 0.0
    density = direct / (n_words + 20)
    return [math.log1p(surprise), min(surprise, 60.0) / 10, math.log1p(direct), min(4.0, 20 * density), math.log1p(quoted), best / 5, math.log1p(len(terms)), math.log1p(n_words) / 5 if n else 0.0]


def _evidence(rows: DataFrame, weight, chance, *extra: str) -> DataFrame:
    """Rows of hits with their evidence as an array; ``extra`` columns, doubles, stay."""
    held = rows.sparkSession.sparkContext.broadcast((weight, chance))

    def describe(batches):
        own, rates = held.value
        for batch in batches:
            hits = [[(h["term"], h["kind"], h["n"]) for h in hs] for hs in batch.column(2).to_pylist()]
            x = [evidence(h, n, own, rates) for h, n in zip(hits, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(3 + i) for i in range(len(extra))), pa.array(x, pa.list_(pa.float64()))], ["doc_id", *extra, "x"])

    return rows.select("doc_id", "n_words", "hits", *extra).mapInArrow(describe, ", ".join(["doc_id long", *(f"{c} double" for c in extra), "x array<double>"]))


def score_toxicity(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity(), learn_from: Column | None = None, seeds: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the probability that a text is toxic, for every row of ``docs``, from its whole text alone.

    Learns from the texts of all rows of ``labels`` with a toxic mark (1 or 0),
    as far as ``learn_from``, a condition on doc_id, allows. ``seeds``: words
    that are terms in any case, with how many times as often they occur in toxic
    texts. Null texts are empty; null ids are not learnt from; rows that repeat
    an id are documents of their own; without toxic and other labels, every
    score is the share of toxic labels, or 0.5 without any. Other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    condition = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(True))
    marks = own_columns(labels, doc_id="doc_id", toxic="toxic").where("toxic is not null and doc_id is not null").where(condition)
    marks = marks.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    source = own_columns(docs, doc_id=id_col, text=text_col)
    rates = learn_terms(source.join(small_side(marks), "doc_id").select("doc_id", "text", "toxic"), scratch, p)
    lowest = min([r[1] for r in rates.values()], default=1e-6)
    rates |= {(fold(w), False): (lowest * times, lowest) for w, times in (seeds or {}).items() if fold(w) and (fold(w), False) not in rates}
    terms = list(rates)
    hits = scratch.save(_match(source, terms, p), "hits")
    known = hits.join(small_side(marks), "doc_id")
    counts = {r["toxic"]: (r["n"], r["words"]) for r in known.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).collect()}
    n = sum(c[0] for c in counts.values())
    if len(counts) < 2 or not terms:
        share = counts.get(1, (0, 0))[0] / n if n else 0.5
        return hits.select("doc_id", F.lit(float(share)).alias("score"))
    own = known.select("toxic", F.explode("hits").alias("h")).groupBy("h.term", "h.kind").agg(F.sum(F.col("toxic") * F.least(F.col("h.n"), F.lit(2))).alias("a"), F.sum((1 - F.col("toxic")) * F.least(F.col("h.n"), F.lit(2))).alias("b"))
    tallies = {(r["term"], r["kind"]): (r["a"], r["b"]) for r in own.collect()}  # bounded by the lexicon
    weight = weights(list(rates.values()), tallies, (counts[1][1], counts[0][1]), p)
    chance = [r[1] for r in rates.values()]
    rows = scratch.save(_evidence(known.withColumn("label", F.col("toxic").cast("double")), weight, chance, "label"), "labelled")
    model = LogisticRegression(maxIter=60, regParam=1e-4, featuresCol="v", labelCol="label").fit(rows.select("label", array_to_vector("x").alias("v")))
    z = F.lit(float(model.intercept))
    for i, c in enumerate(np.asarray(model.coefficients.toArray()).tolist()):
        z = z + F.lit(c) * F.col("x")[i]
    return _evidence(hits, weight, chance).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
