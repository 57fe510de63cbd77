"""Repeated passages: digests of text units grouped globally, the earliest occurrence kept.

Units are lines, and within longer lines the stretches between anchors, words
whose hash is the smallest within ``reach`` words. An anchor depends on the
words around it alone, so a passage set into the middle of different lines is
cut into the same units wherever it stands. Lines too short to be removed for
their length are grouped whole as well, so that a repeated line goes however
short it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut_spans, fresh, own_columns, slices, text_key

#: span: 0 for a unit, for a whole line the number of its units.
UNIT = "rank long, text_key long, unit int, span int, start long, length long, words int, d1 long, d2 long, again boolean"

#: Rank of documents without an id, after all others: this number and some bits of the text's key. Ids are below it.
LATE = 1 << 62
#: Sets the digests of whole lines apart from those of units.
LINE = np.int64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Passages:
    """``reach``: words to each side that an anchor outranks. ``least_words``: of the runs of repeated units that count; whole lines count with fewer."""

    reach: int = 4
    least_words: int = 20


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words between ASCII white space, and the number of line feeds before each."""
    data = np.frombuffer(raw, np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1), np.cumsum(data == 10)[starts]


def unit_starts(h: np.ndarray, line: np.ndarray, reach: int) -> np.ndarray:
    """Indexes of the words that start a unit: the first of a line, anchors, and steps through runs of one word."""
    n = len(h)
    anchor = np.ones(n, bool)
    for k in range(1, min(reach, n - 1) + 1):
        same = line[k:] == line[:-k]
        anchor[k:] &= ~(same & (h[:-k] <= h[k:]))  # of equal words the first
        anchor[:-k] &= ~(same & (h[k:] < h[:-k]))
    step = 2 * reach + 1
    edges = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (line[1:] != line[:-1])) + 1, [n]])
    for k in np.flatnonzero(np.diff(edges) >= step):  # one word again and again has no smallest hash
        anchor[edges[k] : edges[k + 1] : step] = True
        anchor[edges[k + 1] : edges[k + 1] + 1] = True
    anchor[0] = True
    anchor[1:] |= line[1:] != line[:-1]
    return np.flatnonzero(anchor)


def units_of(text: str, reach: int, least: int) -> tuple[np.ndarray, ...]:
    """unit, span, start and length in characters, words and the two digests of every unit of a text, then of every line of fewer than ``least`` words."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends, line = word_places(raw)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 7
    h = np.fromiter(map(xxhash.xxh64_intdigest, raw.lower().split()), np.uint64, len(starts))
    first = unit_starts(h, line, reach)
    words = np.diff(np.append(first, len(h)))
    d1, d2 = digests(h, first, words)
    unit, span = np.arange(len(first)), np.zeros(len(first), np.int64)
    heads = np.flatnonzero(np.diff(line[first], prepend=-1))  # units that start a line
    length = np.diff(np.append(first[heads], len(h)))
    short = length < least
    if short.any():
        n = length[short]
        l1, l2 = digests(h[np.repeat(short, length)], np.cumsum(n) - n, n)
        unit, span = np.append(unit, heads[short]), np.append(span, np.diff(np.append(heads, len(first)))[short])
        first, words, d1, d2 = np.append(first, first[heads[short]]), np.append(words, n), np.append(d1, l1 ^ LINE), np.append(d2, l2)
    a, b = starts[first], ends[first + words - 1]
    if not text.isascii():
        before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        a, b = before[a], before[b]
    return unit, span, a, b - a, words, d1, d2


def digests(h: np.ndarray, first: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Two digests of each stretch of word hashes, which follow one another without gaps."""
    place = np.arange(len(h)) - np.repeat(first, words)
    return [np.add.reduceat(h * f, first).view(np.int64) for f in place_factors(place)]


def place_factors(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers that depend on the place alone, by mixing it."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        x = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(seed)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((x ^ (x >> np.uint64(29))) | np.uint64(1))
    return tuple(out)


def repeated_passages(docs: DataFrame, params: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of documents that an earlier document, or an earlier place of the same one, has too.

    Returns doc_id, start and length (in characters of the original text),
    n_words and first_doc_id, the smallest id that has the passage's first unit
    (of a passage of whole lines under ``least_words``, its first line).
    Units are compared with A-Z in lower case and by their words alone; of equal
    units the one of the smallest doc_id, and in it the first, is the one to
    keep. Neighbouring units to remove are one passage; of passages of fewer than
    ``least_words`` words those lines go that an earlier whole line equals, and
    parts of lines stay. Null and empty texts have no units. Null ids come after
    all others, in the order of text_key (of id and text, which the result has
    too); a first_doc_id may be null then. Rows that repeat an id with different
    texts keep what they share, as they rank the same, and lose what earlier ids
    have. An empty table gives no rows; other columns are ignored.
    """
    return _passages(own_columns(docs, doc_id=id_col, text=text_col), params, Scratch(docs.sparkSession, "passages"))


def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c)) for c in zip(*held, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["rank", "text_key", "unit", "span", "start", "length", "words", "d1", "d2", "again"])


def neighbours(units: list[dict]) -> list[list[dict]]:
    """Units in order as runs without gaps."""
    runs: list[list[dict]] = []
    for u in units:
        if runs and u["unit"] == runs[-1][-1]["unit"] + 1:
            runs[-1].append(u)
        else:
            runs.append([u])
    return runs


def _passages(source: DataFrame, params: Passages, scratch: Scratch) -> DataFrame:
    reach, least = params.reach, params.least_words

    rank = F.coalesce("doc_id", F.lit(LATE).bitwiseOR(F.shiftrightunsigned("text_key", 2)))

    def cut(batches):
        for batch in slices(batches, 2, size=1 << 19):
            held: list[list[np.ndarray]] = []
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                unit, span, a, n, words, d1, d2 = units_of(text, reach, least)
                again = np.ones(len(d1), bool)
                again[np.unique(d1, return_index=True)[1]] = False
                held.append([np.full(len(a), doc, np.int64), np.full(len(a), key, np.int64), unit.astype(np.int32), span.astype(np.int32), a.astype(np.int64), n.astype(np.int64), words.astype(np.int32), d1, d2, again])
            yield packed(held)

    named = source.where("text <> ''").withColumn("text_key", text_key()).select(rank.alias("rank"), "text_key", "text")
    units = scratch.save(named.mapInArrow(cut, UNIT), "units", compression="zstd")
    groups = units.groupBy("d1", "d2").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("again").alias("again"))
    groups = scratch.save(groups.where("last > first or again").select("d1", "d2", "first"), "groups")
    gone = units.join(groups, ["d1", "d2"]).where("rank > first or again")
    # a passage: neighbouring units to remove, told apart by unit number less rank
    runs = gone.groupBy("rank", "text_key").agg(F.array_sort(F.collect_set(F.struct("unit", "span", "start", "length", "words", "first"))).alias("u"))
    doc_id = lambda c: F.when(F.col(c) < LATE, F.col(c))
    runs = runs.select(doc_id("rank").alias("doc_id"), "text_key", F.transform("u", lambda u: u.withField("first", F.when(u["first"] < LATE, u["first"]))).alias("u"))

    def join(batches):
        for batch in batches:
            rows = []
            for doc_id, key, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = {u["unit"] + k: u["first"] for u in found if u["span"] for k in range(u["span"])}
                for run in neighbours([u for u in found if not u["span"]]):
                    if sum(u["words"] for u in run) >= least:
                        parts, short = [run], False
                    else:
                        parts, short = neighbours([u for u in run if u["unit"] in lines]), True
                    for part in parts:
                        first = lines[part[0]["unit"]] if short else part[0]["first"]
                        rows.append((doc_id, part[0]["start"], part[-1]["start"] + part[-1]["length"] - part[0]["start"], sum(u["words"] for u in part), first, key))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "n_words", "first_doc_id", "text_key"])

    return runs.mapInArrow(join, "doc_id long, start long, length long, n_words long, first_doc_id long, text_key long")


def remove_passages(docs: DataFrame, params: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated passages in their texts; columns stay as they are.

    Every row is cut by its own text's passages, whether its id is null or
    repeats; null texts stay null.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    found = _passages(own_columns(docs, doc_id=id_col, text=text_col), params, scratch)
    spans = found.groupBy(F.col("text_key").alias("cut_key")).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    spans = scratch.save(spans, "spans")
    key = fresh(docs, "row_key")
    marked = docs.withColumn(key, F.xxhash64(docs[f"`{id_col}`"], docs[f"`{text_col}`"]))
    joined = marked.join(spans, marked[key] == spans["cut_key"], "left")
    return joined.select(*[(cut_spans(marked[f"`{c}`"], spans["spans"], F.lit(False)) if c == text_col else marked[f"`{c}`"]).alias(c) for c in docs.columns])
