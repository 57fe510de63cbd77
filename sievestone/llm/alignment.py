"""Alignment of two tokenizers' tokens over whole texts, each distinct segment tokenised and aligned once.

1. Texts are cut before runs of white space, at places where neither vocabulary
   has a token that runs across (``cut_points`` verifies that from both). A
   block of some megabytes of text becomes one row: each document as a sequence
   of the block's distinct segments, and these in packets by hash.
2. Packets of one hash from all blocks meet in one task, which tokenises and
   aligns each distinct segment once and answers every packet. A segment occurs
   at most once a block and hashes are even, so no task is hot.
3. Answers go back to their blocks, which compose the documents' counts and
   groups, and the id pairs that each document links.
4. Numbers of documents a pair are added up, and go back to the blocks likewise.

An alignment is two lists of ids and the path of a merge of their ends: each
step is a link, and says whether the A token ends there, the B token, or both,
which closes a group.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, own_columns
from .tokens import byte_letters

#: Characters of text, about, of a block, and the most documents of one; packets of a block for each shuffle partition.
BLOCK, DOCS, PACKETS = 8 << 20, 1 << 15, 8
#: Steps of a path: the link's A token ends first, its B token, or both.
A_ENDS, B_ENDS, BOTH_END = 0, 1, 2


class ByteLevel:
    """A byte-level BPE of the tokenizers library; strings of its special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        before = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        self.splits = before.get("type") == "ByteLevel" and bool(before.get("use_regex"))
        raw = {letter: byte for byte, letter in byte_letters().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(raw[c] for c in token) if all(c in raw for c in token) else token.encode()

    def encode(self, segments: list[str]) -> list[list[int]]:
        return [self.tokenizer.encode(s, add_special_tokens=False).ids for s in segments]


class Pieces:
    """A sentencepiece BPE with byte fallback, which puts a space before every text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = [self._raw(i) for i in range(self.model.get_piece_size())]
        self.space = self.model.piece_to_id("▁")

    def _raw(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Of segments that start with a space, which the model puts there itself; of others its space is taken off again."""
        found = self.model.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            if s == " ":
                found[k] = [self.space]  # the model puts no space before nothing
            elif s[0] != " " and found[k][:1] == [self.space]:
                found[k] = found[k][1:]
        return found


_MODELS: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def models(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, loaded once a worker process."""
    if (a_path, b_path) not in _MODELS:
        _MODELS[a_path, b_path] = ByteLevel(a_path), Pieces(b_path)
    return _MODELS[a_path, b_path]


def cut_points(a: ByteLevel, b: Pieces) -> str:
    """The white space, of space and line feed, before which a text may be cut if what stands before is none.

    That holds where no token of either vocabulary has such a character right
    after one that is no white space, and where the B model's own space can't
    join what follows. The A model must also split by the usual pattern, whose
    parts never run into white space after them.
    """
    if not a.splits:
        return ""
    tokens = [t.decode("utf-8", "replace") for t in (*a.bytes, *b.bytes)]
    fits = [c for c in " \n" if not any(re.search(rf"\S{c}", t) for t in tokens)]
    return "".join(c for c in fits if c == " " or not any(f" {c}" in t.decode("utf-8", "replace") for t in b.bytes))


def segments(text: str, at: str) -> list[str]:
    """The text with a space before it, cut before runs of white space that start with one of ``at``."""
    text = " " + text
    if not at:
        return [text]
    if set(at) == {" ", "\n"} and not re.search(r"[^\S \n]", text):
        return re.findall(r"\s*\S+|\s+", text)
    return re.split(rf"(?<=\S)(?=[{at}])", text)


def merge_path(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> bytes:
    """The steps of a merge of both lists' ends; both must cover the same bytes."""
    out = bytearray()
    i = j = 0
    left = len(a_bytes[a[0]]) - len(b_bytes[b[0]])  # by how much the A token's end lies behind the B token's
    while True:
        if left < 0:
            out.append(A_ENDS)
            i += 1
            left += len(a_bytes[a[i]])
        elif left > 0:
            out.append(B_ENDS)
            j += 1
            left -= len(b_bytes[b[j]])
        else:
            out.append(BOTH_END)
            i, j = i + 1, j + 1
            if i == len(a):
                return bytes(out)
            left = len(a_bytes[a[i]]) - len(b_bytes[b[j]])


def align_segment(segment: str, a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> tuple[int, int, bytes, bytes, bytes]:
    """Numbers of A and B ids, the ids as bytes, and the path; nothing if the tokens' bytes aren't the segment's."""
    raw = segment.encode("utf-8", "surrogatepass")
    if not a or not b or b"".join([a_bytes[i] for i in a]) != raw or b"".join([b_bytes[i] for i in b]) != raw:
        return 0, 0, b"", b"", b""
    kind = id_type(a_bytes, b_bytes)
    return len(a), len(b), np.array(a, kind).tobytes(), np.array(b, kind).tobytes(), merge_path(a, b, a_bytes, b_bytes)


ID = np.dtype("<u4")


def id_type(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.dtype:
    """Of token ids in answers: two bytes where both vocabularies allow it."""
    return np.dtype("<u2") if max(len(a_bytes), len(b_bytes)) <= 1 << 16 else ID


def pack(*arrays: bytes) -> bytes:
    """Byte strings as one, compressed."""
    return zlib.compress(b"".join([np.array([len(arrays), *map(len, arrays)], ID).tobytes(), *arrays]), 1)


def unpack(packed: bytes) -> list[bytes]:
    raw = zlib.decompress(packed)
    n = int(np.frombuffer(raw, ID, 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, ID, n, 4), dtype=np.int64)
    return [raw[e - size : e] for e, size in zip(ends.tolist(), np.frombuffer(raw, ID, n, 4).tolist(), strict=True)]


CUT = "block long, doc_ids array<long>, sizes binary, sequence binary, order binary, packets array<struct<packet: int, segments: binary>>"
CUT_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("sequence", pa.binary()), ("order", pa.binary()), ("packets", pa.list_(pa.struct([("packet", pa.int32()), ("segments", pa.binary())])))])


def _cut(docs: DataFrame, a_path: str, b_path: str, n_packets: int) -> DataFrame:
    """Blocks of documents, as sequences of the blocks' distinct segments; ``order`` lists these as they lie in the packets."""

    def cut(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), cut_points(*models(a_path, b_path))
        known: dict[str, int] = {}
        ids, sizes, parts, held, n = [], [], [], 0, 0

        def block():
            raw = [s.encode("utf-8", "surrogatepass") for s in known]
            of = np.fromiter(map(xxhash.xxh32_intdigest, raw), np.int64, len(raw)) % n_packets
            order = np.argsort(of, kind="stable")
            numbers, starts = np.unique(of[order], return_index=True)
            packets = []
            for number, own in zip(numbers.tolist(), np.split(order, starts[1:]), strict=False):  # no segments: one empty split
                texts = [raw[k] for k in own.tolist()]
                packets.append({"packet": number, "segments": pack(np.array([len(t) for t in texts], ID).tobytes(), b"".join(texts))})
            row = {"block": (part << 33) + n, "doc_ids": ids, "sizes": zlib.compress(np.array(sizes, ID).tobytes(), 1), "sequence": zlib.compress(np.concatenate([*parts, np.zeros(0, ID)]).tobytes(), 1), "order": zlib.compress(order.astype(ID).tobytes(), 1), "packets": packets}
            return pa.RecordBatch.from_pylist([row], CUT_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = segments(text, at) if text else []
                parts.append(np.array([known.setdefault(s, len(known)) for s in found], ID))
                ids.append(doc_id)
                sizes.append(len(found))
                held += len(text)
                if held >= BLOCK or len(ids) >= DOCS:
                    yield block()
                    known, ids, sizes, parts, held, n = {}, [], [], [], 0, n + 1
        if ids:
            yield block()

    return docs.mapInArrow(cut, CUT)


def _align_distinct(packets: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(block, packet, answer) for (packet, block, segments); each distinct segment of a packet is tokenised and aligned once.

    A task goes through its packets one after the other and holds the distinct
    segments of one of them.
    """

    def align(batches):
        a, b = models(a_path, b_path)
        last, known = None, {}
        for batch in batches:
            answers = []
            for packet, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if packet != last:
                    last, known = packet, {}
                sizes, raw = unpack(packed)
                ends = np.cumsum(np.frombuffer(sizes, ID), dtype=np.int64).tolist()
                texts = [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]
                new = [t for t in texts if t not in known]
                own = [t.decode("utf-8", "surrogatepass") for t in new]
                if new:
                    known.update(zip(new, map(align_segment, own, a.encode(own), b.encode(own), [a.bytes] * len(new), [b.bytes] * len(new)), strict=True))
                found = [known[t] for t in texts]
                counts = np.array([(x[0], x[1], len(x[4])) for x in found], ID).reshape(-1, 3)
                answers.append(pack(counts.tobytes(), *(b"".join([x[k] for x in found]) for k in (2, 3, 4))))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(answers, pa.binary())], ["block", "packet", "answer"])

    return packets.repartition("packet").sortWithinPartitions("packet").mapInArrow(align, "block long, packet int, answer binary")


def group_texts(a: np.ndarray, b: np.ndarray, path: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Of each segment, its groups as ``a1,a2|b1;a3|b2,b3``, from the ids and steps of all of them; ``lengths``: steps of each."""
    if not len(lengths):
        return []
    closes = path == BOTH_END
    group = np.cumsum(closes) - closes  # of each step
    of_a, of_b = group[path != B_ENDS], group[path != A_ENDS]  # of each token
    last_a, last_b = (np.append(of[1:] != of[:-1], True) for of in (of_a, of_b))
    done = np.zeros(len(path), bool)
    done[np.cumsum(lengths)[lengths > 0] - 1] = True  # steps that end a segment
    ends = done[closes]  # of each group
    side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
    order = np.lexsort((side, np.concatenate([of_a, of_b])))
    ids = np.concatenate([a, b])[order].tolist()
    marks = np.concatenate([np.where(last_a, 1, 0), np.where(last_b, np.where(ends[of_b], 3, 2), 0)])[order].tolist()
    signs = (",", "|", ";", "\n")
    texts = iter("".join([f"{i}{signs[m]}" for i, m in zip(ids, marks, strict=True)]).split("\n"))
    return [next(texts) if n else "" for n in lengths.tolist()]


COMPOSED = "block long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, groups: string, held: binary>>, pairs array<long>, n_docs array<int>"
DOC_ARROW = pa.struct([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("groups", pa.string()), ("held", pa.binary())])
COMPOSED_ARROW = pa.schema([("block", pa.int64()), ("docs", pa.list_(DOC_ARROW)), ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int32()))])


def _compose(blocks: DataFrame, kind: np.dtype, width: int, keep_groups: bool) -> DataFrame:
    """A row for each block: its documents with their counts and the pairs they link, and the block's pairs with how many of its documents link them."""

    def whole(row: dict) -> pa.RecordBatch:
        answers = [unpack(x["answer"]) for x in sorted(row["answers"], key=lambda x: x["packet"])]
        joined = lambda k, kind: np.frombuffer(b"".join([x[k] for x in answers]), kind)
        n_a, n_b, lengths = joined(0, ID).astype(np.int64).reshape(-1, 3).T
        a, b, path = joined(1, kind), joined(2, kind), joined(3, np.uint8)
        texts = group_texts(a, b, path, lengths)
        on_a, on_b = path != B_ENDS, path != A_ENDS
        links = a[np.cumsum(on_a) - on_a].astype(np.int64) * width + b[np.cumsum(on_b) - on_b]
        pairs, local = np.unique(links, return_inverse=True)
        starts = np.cumsum(lengths) - lengths
        closed = np.concatenate([[0], np.cumsum(path == BOTH_END)])
        counts = np.stack([n_a, n_b, closed[starts + lengths] - closed[starts], lengths], axis=1)
        place = np.empty(len(lengths), np.int64)  # of the block's segments in the packets
        place[np.frombuffer(zlib.decompress(row["order"]), ID)] = np.arange(len(lengths))
        sequence = place[np.frombuffer(zlib.decompress(row["sequence"]), ID)]
        sizes = np.frombuffer(zlib.decompress(row["sizes"]), ID).tolist()
        n_docs = np.zeros(len(pairs), np.int32)
        docs, at = [], 0
        for doc_id, size in zip(row["doc_ids"], sizes, strict=True):
            own = sequence[at : at + size]
            at += size
            steps = lengths[own]
            if not size or not steps.all():
                docs.append({"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "groups": "" if keep_groups else None, "held": None})
                continue
            text = ";".join([texts[k] for k in own.tolist()])
            ends = np.cumsum(steps)
            linked, times = np.unique(local[np.repeat(starts[own] - (ends - steps), steps) + np.arange(ends[-1])], return_counts=True)
            n_docs[linked] += 1
            held = zlib.compress(np.concatenate([np.diff(linked, prepend=0), times]).astype(ID).tobytes(), 1)
            total = dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts[own].sum(axis=0).tolist(), strict=True))
            docs.append({"doc_id": doc_id, **total, "groups_sha256": hashlib.sha256(text.encode()).hexdigest(), "groups": text if keep_groups else None, "held": held})
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        return pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), lists(docs, DOC_ARROW), lists(pairs, pa.int64()), lists(n_docs, pa.int32())], schema=COMPOSED_ARROW)

    def compose(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield whole(batch.slice(k, 1).to_pylist()[0])

    return blocks.mapInArrow(compose, COMPOSED)


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
OUT_ARROW = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string()), ("groups", pa.string())])


def _counted(blocks: DataFrame) -> DataFrame:
    """Documents of blocks whose pairs have their corpus-wide counts."""

    def count(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                docs, stats = batch.column("docs")[k].as_py(), batch.column("stats")[k].values
                n = best = np.zeros(0, np.int64)
                if stats is not None:
                    at = stats.field("at").to_numpy()
                    n, best = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
                    n[at], best[at] = stats.field("n").to_numpy(), stats.field("best").to_numpy()
                for doc in docs:
                    held = doc.pop("held")
                    doc["n_best"] = doc["count_sum"] = 0
                    if held is not None:
                        deltas, times = np.frombuffer(zlib.decompress(held), ID).astype(np.int64).reshape(2, -1)
                        linked = np.cumsum(deltas)
                        doc["n_best"], doc["count_sum"] = int((best[linked] * times).sum()), int((n[linked] * times).sum())
                yield pa.RecordBatch.from_pylist(docs, OUT_ARROW)

    return blocks.mapInArrow(count, OUT)


def align_documents(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tokens of two tokenizers, aligned by bytes: a row for each document, and the id pairs that documents link.

    ``a_path``: a byte-level BPE of the tokenizers library; ``b_path``: a
    sentencepiece BPE with byte fallback. Both see a space and the text; strings
    of special tokens are plain text.

    First result: doc_id, n_a and n_b (tokens), n_groups (stretches between byte
    offsets where tokens of both end), n_links (overlapping pairs of tokens),
    n_best (links whose pair is among the most frequent of its A id), count_sum
    (over links, of the documents that link the pair), groups_sha256, and groups
    as ``a1,a2|b1;a3|b2,b3`` if ``keep_groups``, else null. Second result: a, b,
    n (documents that link the pair), best.

    Texts that are null or empty, or whose tokens' bytes differ from the space
    and the text (as with U+2581), have no tokens: zeros and ''. Rows with null
    or repeated ids are documents of their own; other columns are ignored; empty
    tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    vocabularies = [m.bytes for m in models(a_path, b_path)]
    width = len(vocabularies[1])
    n_packets = PACKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = scratch.save(_cut(own_columns(docs, doc_id=id_col, text=text_col), a_path, b_path, n_packets), "cut")
    packets = cut.select("block", F.explode("packets").alias("p")).select("p.packet", "block", "p.segments")
    answers = scratch.save(_align_distinct(packets, a_path, b_path), "answers")
    answered = answers.groupBy("block").agg(F.collect_list(F.struct("packet", "answer")).alias("answers"))
    blocks = cut.drop("packets").join(answered, "block", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<packet: int, answer: binary>>")))
    composed = scratch.save(_compose(blocks, id_type(*vocabularies), width, keep_groups), "composed")
    scratch.drop("cut", "answers")
    exploded = composed.select("block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.n_docs").alias("n"))
    counts = scratch.save(exploded.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {width}")), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    rated = scratch.save(counts.join(most, "a").select("pair", "a", (F.col("pair") % width).alias("b"), "n", (F.col("n") == F.col("most")).alias("best")), "rated")
    stats = exploded.select("block", "at", "pair").join(rated.select("pair", "n", F.col("best").cast("int").alias("best")), "pair")
    stats = stats.groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("stats"))
    out = _counted(composed.select("block", "docs").join(stats, "block", "left"))
    return out, rated.select("a", "b", "n", "best")
