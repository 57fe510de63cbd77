"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are a bounded sample of texts labelled good; unlabelled are
all texts. A fit starts on a sample of them and then follows the risk over all
rows, whose losses and gradients tasks add up. The class prior is estimated from
positives and unlabelled texts alone, never from labels of bad ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, own_columns, slices, small_batches

SYMBOLS = b"#$%&*+<=>@\\^_`{|}~"


#: Buckets of hashed words; a text's distinct words set a bit each.
BUCKETS = 2048
#: Bins of scores when the prior is estimated.
BINS = 1000


@dataclass(frozen=True)
class PuLearning:
    """``labelled``: most trusted positives that a fit takes. ``start``: unlabelled texts, about, of the sample that it starts on; all of them count in the ``rounds`` after it."""

    labelled: int = 20_000
    start: int = 10_000
    hidden: int = 24
    epochs: int = 20
    rounds: int = 10
    batch: int = 512
    rate: float = 0.01
    seed: int = 3


_KINDS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\t\r\x0b\x0c", b".", b",;:", b"!", b"?", b"'\"()[]-/", SYMBOLS), 1):
    _KINDS[list(_bytes)] = _kind
_KINDS[128:] = 12
N_KINDS = 13


def style(text: str | None) -> np.ndarray:
    """Numbers that describe how a whole text is written: lengths, kinds of characters, word shapes, repetition."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, w = max(1, len(raw)), max(1, len(words))
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=N_KINDS) / n
    lines = [x for line in raw.split(b"\n") if (x := line.strip())]
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    loud = sum(x.isupper() for x in words) / w if kinds[2] else 0.0
    marked = sum(x[-1:] in (b"#", b"$", b"%", b"&", b"*") for x in words) / w if kinds[11] else 0.0
    bare = sum(len(x) == 1 and not x.isalnum() for x in words) / w
    follows = sum(map(bytes.__eq__, words, words[1:])) / w
    per_line = len(words) / max(1, len(lines))
    return np.concatenate([
        np.sqrt(kinds),
        [
            np.log1p(len(raw)) / 10, np.log1p(len(words)) / 8, np.log1p(len(lines)) / 5, np.log1p(per_line) / 6,
            sizes.mean() / 10, min(4.0, sizes.std() / 5), min(4.0, np.log1p(sizes.max()) / 3),
            distinct / w, pairs, len(set(lines)) / max(1, len(lines)), loud, marked, bare, follows, float(not words),
        ],
    ])


N_FEATURES = N_KINDS + 15


def word_bits(text: str | None) -> np.ndarray:
    """Which buckets the text's distinct words, in lower case, fall into, as packed bits."""
    words = set((text or "").lower().encode("utf-8", "surrogatepass").split())
    at = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) % BUCKETS
    out = np.zeros(BUCKETS, np.uint8)
    out[at] = 1
    return np.packbits(out)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Style and packed word bits of whole texts, a row each."""
    return np.array([style(t) for t in texts], np.float32).reshape(-1, N_FEATURES), np.array([word_bits(t) for t in texts], np.uint8).reshape(-1, BUCKETS // 8)


#: The bits of every byte; where the entries of each byte of a row start in a table of 256 for each.
BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
STARTS = 256 * np.arange(BUCKETS // 8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """One hidden layer over standardised style and a linear layer over word bits; ``score`` is the probability of a positive.

    A row's bits count as a vector of unit length. They stay packed: sums of
    weights are looked up, and sums of slopes gathered, byte by byte.
    """

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def new(cls, x: np.ndarray, p: PuLearning) -> "Model":
        rng = np.random.default_rng(p.seed)
        k = x.shape[1]
        weights = [rng.normal(0, 1 / np.sqrt(k), (k, p.hidden)), np.zeros(p.hidden), rng.normal(0, 1 / np.sqrt(p.hidden), p.hidden), np.zeros(1), np.zeros(BUCKETS)]
        return cls(x.mean(axis=0), x.std(axis=0) + 1e-3, weights)

    def forward(self, x: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, tuple]:
        a, b, c, d, w = self.weights
        x, at = np.clip((x - self.mean) / self.scale, -8, 8), bits + STARTS
        length = np.sqrt(np.maximum(1, np.bitwise_count(bits).sum(axis=1)))
        h = np.tanh(x @ a + b)
        return h @ c + d + (w.reshape(-1, 8) @ BYTES.T).ravel()[at].sum(axis=1) / length, (x, at, length, h)

    def gradients(self, held: tuple, g: np.ndarray) -> list[np.ndarray]:
        """Of the sum over rows whose loss has the slope ``g`` in the logit."""
        x, at, length, h = held
        back = np.outer(g, self.weights[2]) * (1 - h * h)
        by_byte = np.bincount(at.ravel(), np.repeat(g / length, at.shape[1]), 32 * BUCKETS).reshape(-1, 256)
        return [x.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()]), (by_byte @ BYTES).ravel()]

    def score(self, x: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(x, bits)[0])


class Adam:
    def __init__(self, model: Model):
        self.model, self.steps = model, 0
        self.first, self.second = ([np.zeros_like(w) for w in model.weights] for _ in range(2))

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        self.steps += 1
        decay = (1e-4, 0.0, 1e-4, 0.0, 1e-3)
        for i, (w, grad) in enumerate(zip(self.model.weights, grads, strict=True)):
            grad = grad + decay[i] * w
            self.first[i] = 0.9 * self.first[i] + 0.1 * grad
            self.second[i] = 0.999 * self.second[i] + 0.001 * grad * grad
            self.model.weights[i] = w - rate * (self.first[i] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[i] / (1 - 0.999**self.steps)) + 1e-8)


def risk_gradients(model: Model, positive: tuple, unlabelled: tuple[float, list[np.ndarray]], prior: float) -> list[np.ndarray]:
    """Gradients of prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), l logistic.

    ``positive``: (style, bits); ``unlabelled``: mean of l(-g) and its gradients.
    Where the estimate of the negatives' risk falls below zero, its gradient is
    followed upwards and the positives' left out, as the non-negative estimator
    has it.
    """
    loss, grads = unlabelled
    n = len(positive[0])
    parts = [tuple(x[at : at + 1000] for x in positive) for at in range(0, n, 1000)]
    wrong = sum(np.logaddexp(0, model.forward(*part)[0]).sum() for part in parts) / n
    away = 1.0 if loss - prior * wrong >= 0 else -1.0
    total = [away * g for g in grads]
    for part in parts:
        z, held = model.forward(*part)
        slope = -away * prior * sigmoid(z) + (prior * (sigmoid(z) - 1) if away > 0 else 0.0)
        total = [a + b for a, b in zip(total, model.gradients(held, slope / n), strict=True)]
    return total


def unlabelled_risk(model: Model, x: np.ndarray, bits: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Sums over rows of l(-g) and of its gradients."""
    z, held = model.forward(x, bits)
    return float(np.logaddexp(0, z).sum()), model.gradients(held, sigmoid(z))


def fit_sample(positive: tuple, unlabelled: tuple, prior: float | None, p: PuLearning) -> Adam:
    """The risk minimised over samples in batches; without a prior, positives told from unlabelled texts by plain logistic loss."""
    rng = np.random.default_rng(p.seed)
    adam = Adam(Model.new(unlabelled[0], p))
    for epoch in range(p.epochs):
        rate = p.rate * 0.5 * (1 + np.cos(np.pi * epoch / p.epochs))
        order = rng.permutation(len(unlabelled[0]))
        for at in range(0, len(order), p.batch):
            u = order[at : at + p.batch]
            q = rng.integers(0, len(positive[0]), min(len(positive[0]), p.batch))
            part = tuple(x[q] for x in positive)
            loss, grads = unlabelled_risk(adam.model, *(x[u] for x in unlabelled))
            own = (loss / len(u), [g / len(u) for g in grads])
            if prior is None:
                z, held = adam.model.forward(*part)
                grads = [a + b for a, b in zip(own[1], adam.model.gradients(held, (sigmoid(z) - 1) / len(z)), strict=True)]
            else:
                grads = risk_gradients(adam.model, part, own, prior)
            adam.step(grads, rate)
    return adam


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled texts, from counts of scores in bins, ascending, of held-out positives and of unlabelled texts.

    Above a good threshold nearly all unlabelled texts are positive, so the
    share of them there over that of positives tends to the prior from above;
    the threshold with the least upper confidence bound of it is taken (the best
    bin of Garg and others, 2021).
    """
    n, m = positive.sum(), unlabelled.sum()
    if not n or not m:
        return 0.5
    q, u = positive[::-1].cumsum() / n, unlabelled[::-1].cumsum() / m
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(m) + 1 / np.sqrt(n))
    seen = q > 0
    best = int(np.argmin((u[seen] + 1.01 * slack) / q[seen]))
    return float(np.clip((u[seen] / q[seen])[best], 0.02, 0.98))


FEATURES = "mark int, x binary, bits binary"


def _featured(source: DataFrame) -> DataFrame:
    """mark, and a text's style and word bits as bytes, for (mark, text)."""

    def describe(batches):
        for batch in slices(batches, 1):
            x, bits = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in bits], pa.binary())], ["mark", "x", "bits"])

    return source.mapInArrow(describe, FEATURES)


def _unpacked(x, bits) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(x), np.float32).reshape(-1, N_FEATURES), np.frombuffer(b"".join(bits), np.uint8).reshape(-1, BUCKETS // 8)


def _summed(rows: DataFrame, size: int, each) -> np.ndarray:
    """The sum over all rows of vectors of ``size`` numbers that ``each`` makes of style and bits; tasks add theirs, then sixteen tasks those sums."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                total += each(*_unpacked(part.column("x").to_pylist(), part.column("bits").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def again(batches):
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    sums = rows.select("x", "bits").mapInArrow(add, "sum binary").repartition(16).mapInArrow(again, "sum binary")
    return sum((np.frombuffer(bytes(r["sum"])) for r in sums.collect()), np.zeros(size))


def _bounded(ids: DataFrame, most: int) -> DataFrame:
    """At most about ``most`` ids, by their hash: all of them if there are no more."""
    n = ids.count()
    if n <= most:
        return ids
    return ids.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def train(docs: DataFrame, labels: DataFrame, p: PuLearning = PuLearning(), learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model | None, float]:
    """A model and the class prior, which is estimated from positives and unlabelled texts.

    Trusted positives are texts labelled 1: of their ids at most about
    ``p.labelled``, by hash, one text an id. Unlabelled are all texts, labelled
    or not; null ids and repeated rows count. ``learn_from``, a condition on
    doc_id, limits both. Without positives there is no model and the prior is
    0.5. Null texts are empty, null labels none; empty tables give no model.
    """
    condition = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(True))
    scratch = Scratch(docs.sparkSession, "quality")
    marks = own_columns(labels, doc_id="doc_id", quality="quality").where("quality = 1 and doc_id is not null").where(condition)
    source = own_columns(docs, doc_id=id_col, text=text_col).where(condition)
    trusted = F.broadcast(_bounded(marks.select("doc_id").distinct(), p.labelled))  # bounded by the parameter
    texts = source.join(trusted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    held = texts.select((F.xxhash64("doc_id", F.lit(12)) % 2 == 0).cast("int").alias("mark"), "text")
    positives = _featured(held).collect()
    if not positives:
        return None, 0.5
    every = scratch.save(_featured(source.select(F.lit(0).alias("mark"), "text")), "features")
    n = every.count()
    first = every.where(F.pmod(F.xxhash64("x", "bits", F.lit(p.seed)), F.lit(1 << 30)) < int((1 << 30) * p.start / n)) if n > p.start else every
    start = _unpacked(*zip(*[(r["x"], r["bits"]) for r in first.select("x", "bits").collect()], strict=True))
    half = [_unpacked(*(([r[c] for r in positives if r["mark"] == k]) for c in ("x", "bits"))) for k in (0, 1)]
    good = tuple(np.concatenate(x) for x in zip(*half, strict=True))
    if min(len(h[0]) for h in half):
        apart = fit_sample(half[0], start, None, p).model
        counted = lambda x, bits: np.bincount(np.minimum(BINS - 1, (apart.score(x, bits) * BINS).astype(np.int64)), minlength=BINS).astype(np.float64)
        prior = class_prior(counted(*half[1]), _summed(every, BINS, counted))
    else:
        prior = 0.5
    adam = fit_sample(good, start, prior, p)
    shapes = [w.shape for w in adam.model.weights]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    for k in range(p.rounds):
        model = adam.model

        def risk(x, bits, model=model):
            loss, grads = unlabelled_risk(model, x, bits)
            return np.concatenate([[loss], *[g.ravel() for g in grads]])

        total = _summed(every, 1 + int(ends[-1]), risk) / n
        grads = [g.reshape(s) for g, s in zip(np.split(total[1:], ends[:-1]), shapes, strict=True)]
        adam.step(risk_gradients(model, good, (total[0], grads), prior), p.rate * 0.1 * (1 - k / p.rounds))
    scratch.drop("features")
    return adam.model, prior


def score(docs: DataFrame, model: tuple[Model | None, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the probability of good quality, for every row, from its whole text alone.

    A null text counts as empty. Without a model every score is the prior. Ids
    may be null or repeat; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        own, prior = held.value
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            scores = own.score(*features(texts)).astype(np.float64) if own else np.full(len(texts), prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(rate, "doc_id long, score double")


def keep_good(docs: DataFrame, model: tuple[Model | None, float], least: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` whose texts score at least ``least``, all columns as they are; without a model, all of them."""
    if model[0] is None:
        return docs
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def good(batches):
        own, _ = held.value
        for batch in slices(batches, at):
            yield batch.filter(pa.array(own.score(*features(batch.column(at).to_pylist())) >= least))

    return docs.mapInArrow(good, docs.schema)
