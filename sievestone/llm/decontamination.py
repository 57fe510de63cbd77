"""Benchmark decontamination: test n-grams looked for in all windows of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut_spans, fresh, own_columns, slices, text_key

#: A-Z in lower case; every other ASCII byte that is no letter or digit a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: (window, item) rows that one broadcast may hold; more are looked for in so many passes.
BLOCK_ROWS = 1_000_000
HITS = "doc_id long, text_key long, n_words long, spans array<struct<start:long,end:long,words:long>>, items array<long>"
_K = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def windows_of(text: str | None, n: int) -> Iterator[bytes]:
    """An item's windows: n consecutive words; fewer words, but not none, are one window."""
    words = words_of(text)
    if words:
        for i in range(max(1, len(words) - n + 1)):
            yield b" ".join(words[i : i + n])


class Windows:
    """Broadcast form of one block of windows: numbered words, windows of numbers by length, their items."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        self.words: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], list[int]] = {}
        for window, item in rows:
            key = tuple(self.words.setdefault(w, len(self.words) + 1) for w in window.split(b" "))
            self.items.setdefault(key, []).append(item)
        self.maps = {}
        for n in sorted({len(k) for k in self.items}):
            own = np.array([k for k in self.items if len(k) == n], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(self.mixed(own.T, n) >> np.uint64(44)).astype(np.int64)] = True
            self.maps[n] = seen

    @staticmethod
    def mixed(columns, n: int) -> np.ndarray:
        total = np.uint64(n)
        for i in range(n):
            total = (total + columns[i]) * _K
            total = total ^ (total >> np.uint64(31))
        return total * _K

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence of a window, and the items of those windows."""
        hit, items = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.words.get, words, repeat(0)), np.uint64, len(words))
        known = ids > 0
        if known.any():
            for n, seen in self.maps.items():
                if len(ids) < n:
                    continue
                whole = np.convolve(known, np.ones(n, np.int64), "valid") == n if n > 1 else known
                at = np.flatnonzero(whole)
                if not len(at):
                    continue
                maybe = at[seen[(self.mixed([ids[at + i] for i in range(n)], n) >> np.uint64(44)).astype(np.int64)]]
                for i in maybe.tolist():
                    if (found := self.items.get(tuple(ids[i : i + n].tolist()))) is not None:
                        hit[i : i + n] = True
                        items.update(found)
        return hit, items


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of folded bytes starts and ends."""
    inside = np.frombuffer(data, np.uint8) != 32
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scan(source: DataFrame, windows, every_row: bool) -> DataFrame:
    def scan(batches):
        own = windows.value
        for batch in slices(batches, 1):
            rows = []
            for doc_id, text, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                hit, items = own.find(words) if words else (np.zeros(0, bool), set())
                if not (every_row or hit.any()):
                    continue
                spans = []
                if hit.any():
                    raw = text.encode("utf-8", "surrogatepass")
                    a, b = word_bounds(raw.translate(FOLD))
                    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
                    spans = [(int(a[i]), int(b[j - 1]), int(j - i)) for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                rows.append((doc_id, key, len(words), spans, sorted(items)))
            if rows:
                d, k, n, s, i = zip(*rows, strict=True)
                span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])
                spans = pa.array([[dict(zip(("start", "end", "words"), x, strict=True)) for x in y] for y in s], pa.list_(span))
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(n, pa.int64()), spans, pa.array(i, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_words", "spans", "items"])

    return source.mapInArrow(scan, HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Where windows of benchmark items occur in documents.

    Returns a row for each document: doc_id, text_key (of id and text), n_words, spans (byte offsets of runs of hit words in the UTF-8 text, and the
    words in them) and items (sorted ids of the items whose windows occur).
    Words are runs of letters and digits, A-Z lower-cased, any character beyond
    ASCII a letter; a word inside any occurrence of a window is hit. The windows
    are counted first and broadcast in blocks of ``block_rows`` rows, each block
    against all documents; the next is collected when that pass is written. Null and wordless texts have n_words 0; items without
    id or words are left out; an empty benchmark hits nothing. Repeated rows
    are documents of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    source = own_columns(docs, doc_id=id_col, text=text_col).withColumn("text_key", text_key())

    def cut(batches):
        for batch in batches:
            rows = [(w, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in windows_of(t, n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["window", "item"])

    windows = own_columns(benchmark, item=item_col, text=item_text_col).where("item is not null")
    windows = scratch.save(windows.select("item", "text").mapInArrow(cut, "window binary, item long").distinct(), "windows")
    blocks = max(1, -(-windows.count() // block_rows))
    passes = []
    for k in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k) if blocks > 1 else windows
        held = spark.sparkContext.broadcast(Windows([(bytes(r["window"]), r["item"]) for r in own.toLocalIterator()]))
        found = _scan(source, held, k == 0)
        if blocks == 1:
            return found
        passes.append(scratch.save(found, f"pass-{k}"))
        held.destroy()
    first = passes[0]
    more = first.where(F.size("spans") > 0)
    for other in passes[1:]:
        more = more.unionByName(other)
    met = more.select("doc_id", "text_key", F.explode("spans").alias("s"), "items")
    met = met.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("s")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("i"))
    met = scratch.save(met, "met")

    def merge(batches):  # overlapping spans of different blocks become one, its words counted anew
        for batch in slices(batches, 4):
            rows = batch.to_pylist()
            for r in rows:
                a, b = word_bounds(r.pop("text").encode("utf-8", "surrogatepass").translate(FOLD))
                hit = np.zeros(len(a), bool)
                for s in r["s"]:
                    hit[np.searchsorted(a, s["start"]) : np.searchsorted(b, s["end"]) + 1] = True
                edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
                r["s"] = [{"start": int(a[i]), "end": int(b[j - 1]), "words": int(j - i)} for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
            yield from pa.Table.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("s", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))), ("i", pa.list_(pa.int64()))])).to_batches()

    texts = met.alias("m").join(source.alias("t"), F.expr("m.doc_id <=> t.doc_id and m.text_key = t.text_key")).select("m.doc_id", "m.text_key", "s", "i", "text")
    met = texts.mapInArrow(merge, "doc_id long, text_key long, s array<struct<start:long,end:long,words:long>>, i array<long>").dropDuplicates(["doc_id", "text_key"])
    joined = first.select("doc_id", "text_key", "n_words").alias("f").join(met.alias("m"), F.expr("f.doc_id <=> m.doc_id and f.text_key = m.text_key"), "left")
    return joined.select("f.doc_id", "f.text_key", "n_words", F.coalesce("s", F.array()).cast("array<struct<start:bigint,end:bigint,words:bigint>>").alias("spans"), F.coalesce("i", F.array()).cast("array<bigint>").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, spans_only: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or, with ``spans_only``, without the hit spans of their texts.

    Columns stay as they are. Every row is judged by its own text, whether its
    id is null or repeats; null texts are kept.
    """
    hits = contamination(docs, benchmark, n, id_col, text_col).where(F.size("spans") > 0)
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "spans").dropDuplicates(["hit_id", "hit_key"])
    hits = Scratch(docs.sparkSession, "hits").save(hits, "hits")
    key = fresh(docs, "row_key")
    marked = docs.withColumn(key, F.xxhash64(docs[f"`{id_col}`"], docs[f"`{text_col}`"]))
    same = marked[f"`{id_col}`"].eqNullSafe(hits["hit_id"]) & (marked[key] == hits["hit_key"])
    if not spans_only:
        return marked.join(hits.select("hit_id", "hit_key"), same, "left_anti").drop(key)
    joined = marked.join(hits, same, "left")
    spans = F.transform(hits["spans"], lambda s: F.struct(s["start"], s["end"]))
    return joined.select(*[(cut_spans(marked[f"`{c}`"], spans, F.lit(True)) if c == text_col else marked[f"`{c}`"]).alias(c) for c in docs.columns])
