"""Vector bin packing of tokenised examples into sequences under several limits at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import own_columns, slices, small_batches
from .tokens import encoder

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Packing:
    """Limits of one sequence. ``window`` examples compete for a place at a time."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048
    window: int = 256


class Packer:
    """Places pieces of examples, streaming, with at most ``window`` examples in hand.

    A sequence takes, again and again, the example whose demand (tokens, one
    segment, loss-bearing tokens, each as a share of its limit) has the largest
    dot product with what the sequence has left, among those that fit; if none
    fits and room is left, the one with the largest product is cut to fill it.
    """

    def __init__(self, p: Packing, first_sequence: int = 0):
        self.p, self.sequence = p, first_sequence
        self.limit = np.array([p.tokens, p.segments, p.loss_tokens], np.float64)
        self.held: list[list] = []  # key, next token, tokens left, first loss-bearing token
        self.demand = np.zeros((p.window, 3))  # of the examples held, in the first rows
        self.left = self.limit.copy()
        self.open: list[tuple] = []

    def add(self, key, tokens: int, loss_from: int = 0):
        """Take an example; yields finished sequences as (sequence, [(key, start, length, offset)])."""
        self.held.append([key, 0, tokens, loss_from])
        self.demand[len(self.held) - 1] = self._demand(self.held[-1])
        while len(self.held) >= self.p.window:
            yield from self._step()

    def finish(self):
        """Place all that is left. The last sequence is cut into lengths that are powers of two, which need no padding."""
        while self.held:
            yield from self._step()
        pieces, self.open = self.open, []
        self.left = self.limit.copy()
        total = sum(n for _, _, n, _ in pieces)
        if total in (0, self.p.tokens):
            if pieces:
                yield self._close(pieces)
            return
        for bit in reversed(range(total.bit_length())):
            room, part = total & (1 << bit), []
            while room:
                key, start, n, _ = pieces[0]
                take = min(n, room)
                part.append((key, start, take, (total & (1 << bit)) - room))
                room -= take
                pieces[:1] = [(key, start + take, n - take, 0)] if take < n else []
            if part:
                yield self._close(part)

    def _demand(self, example: list) -> np.ndarray:
        _, start, n, loss_from = example
        return np.array([n, 1, max(0, start + n - max(start, loss_from))]) / self.limit

    def _step(self):
        left = self.left / self.limit
        demand = self.demand[: len(self.held)]
        fits = (demand <= left + 1e-12).all(axis=1)
        score = demand @ left
        if fits.any():
            i = int(np.argmax(np.where(fits, score, -1.0)))
            take = self.held[i][2]
        else:
            i = int(np.argmax(score))
            _, start, n, loss_from = self.held[i]
            take = min(n, round(self.left[0]))
            free = max(0, loss_from - start)  # tokens before the loss begins
            take = min(take, free + round(self.left[2]))
            if take <= 0 or round(self.left[1]) < 1:
                yield self._close(self.open)
                self.open, self.left = [], self.limit.copy()
                return
        key, start, n, loss_from = self.held[i]
        self.open.append((key, start, take, self.p.tokens - round(self.left[0])))
        self.left -= np.array([take, 1, max(0, start + take - max(start, loss_from))])
        if take < n:
            self.held[i] = [key, start + take, n - take, loss_from]
            self.demand[i] = self._demand(self.held[i])
        else:
            self.held[i], self.demand[i] = self.held[-1], self.demand[len(self.held) - 1]
            self.held.pop()
        if round(self.left[0]) == 0:
            yield self._close(self.open)
            self.open, self.left = [], self.limit.copy()

    def _close(self, pieces: list[tuple]):
        self.sequence += 1
        return self.sequence - 1, pieces


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, params: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """Pieces of all documents, each token in exactly one, with their place in sequences.

    A document is its text's ids and then ``end_id``; a null text is empty. With
    ``prompt_col`` the ids of that text come first and bear no loss; all others
    do. Returns doc_id, start (ids of the document before the
    piece), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id
    and offset. Every task packs the documents it reads, so nothing is
    shuffled and a task holds at most ``window`` documents; it leaves no partly
    filled sequence but by the segment or loss limit. Sequences of a length that is
    a power of two need no padding; the others are padded to ``tokens``. Repeated rows are documents of their own,
    null ids stay null, other columns are ignored, an empty table gives no rows.
    """

    def pack(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        packer = Packer(params, TaskContext.get().partitionId() << 33)
        texts: dict[int, list] = {}  # examples not yet placed in full: doc_id, ids, tokens yet to come
        out: list[tuple] = []
        key = 0

        def take(sequences):
            for sequence, pieces in sequences:
                for k, start, n, offset in pieces:
                    doc = texts[k]
                    out.append((doc[0], start, n, doc[1][start : start + n].tobytes(), len(doc[1]), sequence, offset))
                    doc[2] -= n
                    if not doc[2]:
                        del texts[k]

        def rows():
            columns = zip(*out, strict=True)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return batch

        for batch in slices(batches, 1, rows=4096, size=1 << 22):
            leads = enc.many(batch.column(2).to_pylist()) if prompt_col else [end[:0]] * batch.num_rows
            for doc_id, own, lead in zip(batch.column(0).to_pylist(), enc.many(batch.column(1).to_pylist()), leads, strict=True):
                ids = np.concatenate([lead, own, end], dtype="<u4")
                texts[key] = [doc_id, ids, len(ids)]
                take(packer.add(key, len(ids), len(lead)))
                key += 1
                if len(out) >= 2000:
                    yield rows()
        take(packer.finish())
        if out:
            yield rows()

    small_batches(docs.sparkSession)
    columns = {"doc_id": id_col, "text": text_col} | ({"prompt": prompt_col} if prompt_col else {})
    return own_columns(docs, **columns).mapInArrow(pack, PIECE)
