"""Token ids in canonical length-limited Huffman code, in independent blocks.

A folder holds two Parquet tables. ``codebook``: id and code length for every id
that occurs. ``blocks``: documents in ascending id order, whole documents to a
block; a document starts at a byte of the block's payload, and ``marks`` has the
bit offset, from there, of every 256th token, so that any stretch of 256 tokens
can be decoded by itself.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, own_columns, slices
from .tokens import encoder

MOST_BITS = 16
STRETCH = 256
BLOCK_TOKENS = 1 << 19


def code_lengths(counts: np.ndarray, most: int | None = None) -> np.ndarray:
    """Lengths of an optimal prefix code with none over ``most`` bits, by package-merge.

    Without a limit it is ``MOST_BITS``, or for more ids than half of what those
    can tell apart one bit more than they need. ids without occurrences get length 0; a single id gets length 1. Equal
    weights are taken in id order.
    """
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(ids) <= 1:
        lengths[ids] = 1
        return lengths
    most = most or max(MOST_BITS, int(len(ids) - 1).bit_length() + 1)
    if len(ids) > 1 << most:
        raise ValueError(f"{len(ids)} ids need codes over {most} bits")
    order = ids[np.lexsort((ids, counts[ids]))]
    weights = counts[order].astype(np.float64)
    levels = []  # of each level, whether its cheapest entries are single ids
    packages = np.zeros(0)
    for _ in range(most):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(weights))
        ranked = merged[rank]
        packages = ranked[: len(ranked) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(weights) - 2
    for single in reversed(levels):
        singles = int(single[:take].sum())
        lengths[order[:singles]] += 1
        take = 2 * (take - singles)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    sizes = lengths[order].astype(np.int64)
    steps = np.left_shift(1, int(sizes.max()) - sizes) if len(sizes) else sizes
    starts = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(sizes) else sizes
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = starts >> (int(sizes.max()) - sizes) if len(sizes) else 0
    return codes


def encode_documents(ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Payload of documents laid end to end, each from a byte on; its byte offsets; bit position of every token in its document.

    ``ends``: where each document ends in ``ids``.
    """
    size = lengths[ids].astype(np.int64)
    after = np.cumsum(size)
    tokens = np.diff(ends, prepend=0)
    last = np.concatenate([[0], after])[ends]
    bits = np.diff(last, prepend=0)
    offsets = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    within = after - size - np.repeat(last - bits, tokens)
    at = within + np.repeat(8 * offsets[:-1], tokens)
    wide = 3 if not len(size) or int(size.max()) <= 16 else 5  # bytes that a code may touch
    word = codes[ids].astype(np.int64) << (8 * wide - size - (at & 7))
    first = at >> 3
    n = int(offsets[-1]) + wide
    out = sum(np.bincount(first + k, (word >> (8 * (wide - 1 - k))) & 255, n) for k in range(wide)) if len(ids) else np.zeros(n)
    return out[: n - wide].astype(np.uint8).tobytes(), offsets, within


def decoder(lengths: np.ndarray):
    """A function from (payload, bit positions, token counts) to ids: all stretches advance together, a table look-up a token."""
    codes = canonical_codes(lengths).astype(np.int64)
    used = np.flatnonzero(lengths)
    most = max(MOST_BITS, int(lengths.max(initial=0)))
    symbol = np.zeros(1 << most, np.uint32)
    length = np.ones(1 << most, np.int64)
    order = used[np.argsort(codes[used] << (most - lengths[used].astype(np.int64)))]
    spans = np.left_shift(1, most - lengths[order].astype(np.int64))
    covered = int(spans.sum())
    symbol[:covered] = np.repeat(order, spans)
    length[:covered] = np.repeat(lengths[order], spans)

    def decode(payload: bytes, at: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.uint32)
        raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(5, np.uint8)]).astype(np.uint32)
        window = (raw[:-4] << 16) | (raw[1:-3] << 8) | raw[2:-2]
        if wide := most > 16:
            window = (window.astype(np.int64) << 16) | (raw[3:-1].astype(np.int64) << 8) | raw[4:]
        far, mask = (40 - most, np.int64((1 << most) - 1)) if wide else (8, np.uint32(0xFFFF))
        longest = np.argsort(-tokens, kind="stable")
        left = tokens[longest]
        at = at[longest].astype(np.int64)
        starts = (np.cumsum(tokens) - tokens)[longest]
        out = np.empty(int(tokens.sum()), np.uint32)
        for t in range(int(left[0])):
            live = int(np.searchsorted(-left, -t, side="left"))
            at, starts = at[:live], starts[:live]
            peek = (window[at >> 3] >> (far - (at & 7)).astype(window.dtype)) & mask
            out[starts + t] = symbol[peek]
            at = at + length[peek]
        return out

    return decode


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, ``end_id`` after each, into files under ``folder``.

    Documents are written in ascending id order: null ids first, rows of one id
    in the order of their code. Null texts are empty. The driver holds one count
    for each token id and one total for each range of documents, no more. An
    empty table gives an empty codebook and no blocks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    source = own_columns(docs, doc_id=id_col, text=text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = source.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))

    def tokenize(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.type).tobytes()
        counts = np.zeros(0, np.int64)
        for batch in slices(batches, 1, rows=4096, size=1 << 22):
            ids = [x.tobytes() + end for x in enc.many(batch.column(1).to_pylist())]
            doc_ids = batch.column(0).to_pylist()
            found = np.bincount(np.frombuffer(b"".join(ids), enc.type), minlength=len(counts))
            found[: len(counts)] += counts
            counts = found
            part = [0 if d is None else bisect_left(cuts, d) for d in doc_ids]
            n = [len(x) // enc.type().itemsize for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array([np.frombuffer(x, enc.type).astype("<u2" if enc.type is np.uint16 else "<u4").tobytes() for x in ids], pa.binary())], ["part", "doc_id", "n", "ids"])
        if len(counts):  # a task's counts, as one more row
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([enc.type().itemsize], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["part", "doc_id", "n", "ids"])

    rows = scratch.save(source.mapInArrow(tokenize, "part int, doc_id long, n long, ids binary"), "ids", compression="zstd")

    def counted(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                c = np.frombuffer(x, "<i8")
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "count"])

    counts = rows.where("part = -1").select("ids").mapInArrow(counted, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect()
    size = max((r["id"] for r in counts), default=-1) + 1
    weight = np.zeros(size, np.int64)
    for r in counts:
        weight[r["id"]] = r["count"]
    lengths = code_lengths(weight)
    codes = canonical_codes(lengths)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    totals = dict(rows.where("part >= 0").groupBy("part").agg(F.sum("n")).collect())
    starts, total = {}, 0
    for part in sorted(totals):
        starts[part] = total
        total += totals[part]

    def compress(batches):
        for batch in batches:
            stored = batch.column(3).to_pylist()
            n = np.array(batch.column(2).to_pylist(), np.int64)
            groups = np.cumsum(n) // BLOCK_TOKENS  # working arrays are a few times the ids that they describe
            edges = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1), len(n)] if len(n) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                ids = np.frombuffer(b"".join(stored[lo:hi]), "<u2" if 2 * n[0] == len(stored[0]) else "<u4")
                ends = np.cumsum(n[lo:hi])
                payload, offsets, within = encode_documents(ids, ends, lengths, codes)
                marks = [within[e - k : e : STRETCH].astype("<u8" if within[e - 1] >> 31 else "<u4").tobytes() for e, k in zip(ends, n[lo:hi], strict=True)]
                code = [payload[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(marks, pa.binary()), pa.array(code, pa.binary())], ["part", "doc_id", "n", "marks", "code"])

    def gather(batches):
        part, at, held, size = None, 0, [], 0

        def block():
            doc_ids, n, marks, code = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([list(doc_ids)], pa.list_(pa.int64())), pa.array([list(n)], pa.list_(pa.int64())), pa.array([list(map(len, code))], pa.list_(pa.int64())), pa.array([list(marks)], pa.list_(pa.binary())), pa.array([b"".join(code)], pa.binary())],
                ["part", "first_token", "doc_ids", "tokens", "bytes", "marks", "payload"],
            )

        for batch in batches:
            for p, *doc in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (p != part or size >= BLOCK_TOKENS):
                    yield block()
                    at, held, size = at + size, [], 0
                if p != part:
                    part, at = p, starts[p]
                held.append(doc)
                size += doc[1]
        if held:
            yield block()

    coded = rows.where("part >= 0").mapInArrow(compress, "part int, doc_id long, n long, marks binary, code binary")
    coded = coded.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "code")
    layout = "part int, first_token long, doc_ids array<long>, tokens array<long>, bytes array<long>, marks array<binary>, payload binary"
    coded.mapInArrow(gather, layout).write.option("compression", "none").parquet(f"{folder}/blocks")
    scratch.drop("ids")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder that ``write_ids`` wrote: doc_id, start (ids of all documents before it), n_tokens and ids, little-endian unsigned 32-bit."""
    book = spark.read.parquet(f"{folder}/codebook").collect()
    lengths = np.zeros(max((r["id"] for r in book), default=-1) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["length"]

    def decode(batches):
        run = decoder(lengths)
        for batch in batches:
            for first, doc_ids, tokens, sizes, marks, payload in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                tokens = np.array(tokens, np.int64)
                base = 8 * (np.cumsum(sizes) - sizes)
                stretches = -(-tokens // STRETCH)
                inner = np.concatenate([np.frombuffer(m, "<u4" if len(m) == 4 * s else "<u8").astype(np.int64) for m, s in zip(marks, stretches, strict=True)])
                at = inner + np.repeat(base, stretches)
                lanes = np.full(len(at), STRETCH, np.int64)
                lanes[np.cumsum(stretches) - 1] = tokens - STRETCH * (stretches - 1)
                ids = run(payload, at, lanes).astype("<u4").tobytes()
                ends = 4 * np.cumsum(tokens)
                starts = first + np.cumsum(tokens) - tokens
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(tokens), pa.array([ids[e - 4 * n : e] for e, n in zip(ends, tokens, strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks").select("first_token", "doc_ids", "tokens", "bytes", "marks", "payload")
    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
