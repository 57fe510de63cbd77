"""Languages of texts as mixtures: EM over n-gram likelihoods, the set chosen by penalised likelihood."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, slices, small_batches

#: A-Z in lower case, every other ASCII byte that is no letter a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Mixture:
    """``buckets``: of hashed byte trigrams. ``penalty``: times log(n) / 2 for each language in a set."""

    buckets: int = 1 << 15
    penalty: float = 6.0
    rounds: int = 12


def trigrams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of a text's letters, and how often each occurs."""
    folded = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split())
    b = np.frombuffer(b" " + folded + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    code = (code >> np.uint32(8)) % np.uint32(buckets)
    if len(code) > 20_000:
        counts = np.bincount(code, minlength=buckets)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(code, return_counts=True)


def train(docs: DataFrame, p: Mixture = Mixture(), text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and log probabilities of buckets in each, from all rows with text and language.

    Tasks add up their counts; the driver gets one number for each language and bucket, whatever the input.
    """
    buckets = p.buckets
    small_batches(docs.sparkSession)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = trigrams(text, buckets)
                total.setdefault(lang, np.zeros(buckets, np.int64))[at] += n
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])

    source = own_columns(docs, lang=lang_col, text=text_col).where("lang is not null and text is not null")
    counts = source.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((len(langs), buckets), 0.5)
    table[np.searchsorted(langs, counts["lang"]) if len(langs) else [], counts["bucket"]] += counts["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def proportions(logp: np.ndarray, at: np.ndarray, n: np.ndarray, p: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Chosen languages and their shares of a text.

    EM gives the shares of all languages; the least is left out as long as that
    raises the log-likelihood less penalty * log(n) / 2 a language. What is left
    goes on from its shares, so that many languages settle as few do.
    """
    single = logp[:, at] @ n
    chosen = np.argsort(-single, kind="stable")
    cost = p.penalty * np.log(max(2, n.sum())) / 2
    best, w = None, np.full(len(chosen), 1 / len(chosen))
    while len(chosen):
        like = logp[np.ix_(chosen, at)]
        top = like.max(axis=0)
        like = np.exp(like - top)
        for _ in range(p.rounds if len(chosen) > 1 else 1):
            share = w[:, None] * like
            w = (share / share.sum(axis=0)) @ n / n.sum()
        score = float((np.log(w @ like) + top) @ n) - cost * len(chosen)
        if best is not None and score <= best[0]:
            break
        best = (score, chosen, w)
        least = int(np.argmin(w))
        chosen, w = np.delete(chosen, least), np.delete(w, least)
        w = w / w.sum() if len(w) else w
    return best[1], best[2]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], p: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and languages (the chosen set with shares, largest first) of every row.

    Whole texts are used. lang_pred is the language of the largest share and
    score that share. Null texts, texts without a letter and any text under a
    model without languages get ``und`` with score 0 and no languages. Ids may
    be null or repeat; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches):
        langs, logp = held.value
        for batch in slices(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                if not langs or not text or not any(map(str.isalpha, text)):
                    rows.append(("und", 0.0, []))
                    continue
                at, n = trigrams(text, p.buckets)
                if not len(at):
                    rows.append(("und", 0.0, []))
                    continue
                who, share = proportions(logp, at, n, p)
                order = np.lexsort((who, -share))
                mix = [{"lang": langs[who[i]], "share": min(1.0, float(share[i]))} for i in order]
                rows.append((mix[0]["lang"], mix[0]["share"], mix))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            a, b, c = (list(x) for x in columns)
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, kind)], ["doc_id", "lang_pred", "score", "languages"])

    return own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(guess, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
