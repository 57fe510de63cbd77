"""Near-duplicate documents by b-bit MinHash over word shingles."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, own_columns, slices, small_side, text_key
from .nearness import Banding, as_long, distinct, finish64, long_lists, near_components

SKETCH = "doc_id long, text_key long, node long, check long, n int, bands array<long>, sig array<long>"


@dataclass(frozen=True)
class NearDedup:
    words: int = 5
    banding: Banding = field(default_factory=Banding)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, w: int) -> set:
    """Distinct runs of w words; fewer words make one run; no words, none."""
    words = words_of(text)
    return set(zip(*(words[i:] for i in range(w)), strict=False)) if len(words) >= w else {tuple(words)} if words else set()


def shingle_hashes(words: list[bytes], w: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    w = min(w, len(words))
    total = np.full(len(words) - w + 1, w, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for i in range(w):
        total = (total + h[i : len(h) - w + 1 + i]) * np.uint64(factor)
        total ^= total >> np.uint64(29)
    return distinct(finish64(total))


def sketch_documents(docs: DataFrame, p: NearDedup) -> DataFrame:
    """A row for each document: its set's size and 128-bit digest in two longs; bands and signature where its task sees the set for the first time."""
    w, banding = p.words, p.banding

    def sketch(batches):
        make = banding.sketcher()
        seen: set[int] = set()
        for batch in slices(batches, 1, size=1 << 19):
            node, check, n, new, held = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                s = shingle_hashes(words, w) if words else np.zeros(0, np.uint64)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                node.append(as_long(d & 0xFFFFFFFFFFFFFFFF) if words else None)
                check.append(as_long(d >> 64) if words else None)
                n.append(len(s))
                new.append(len(s) >= banding.least_size and node[-1] not in seen)
                if new[-1]:
                    held.append((s >> np.uint64(32)).astype(np.uint32))
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(node[-1])
            keys, sig = make(np.concatenate([*held, np.zeros(0, np.uint32)]), np.array([len(h) for h in held], np.int64))
            columns = [batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(n, pa.int32()), long_lists(np.array(new), keys), long_lists(np.array(new), sig)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "check", "n", "bands", "sig"])

    return docs.mapInArrow(sketch, SKETCH)


def minhash_dedup(docs: DataFrame, params: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have similarity >= percent / 100.

    Returns a row for each input row: doc_id, n_shingles (set size),
    component_id (smallest id reachable over links, itself included), kept
    (doc_id = component_id) and text_key (of id and text, which tells rows of
    one id apart). Equal sets are one class, whatever their number; between
    classes candidates share a MinHash band, pass a b-bit estimate and are
    confirmed on the texts' full sets. Texts that are null or have no words have
    n_shingles 0 and link with nothing. Rows with a null id keep a null
    component and kept = true. Rows that repeat an id are documents of their
    own with that id. Other columns of the input are ignored; an empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    source = own_columns(docs, doc_id=id_col, text=text_col).withColumn("text_key", text_key())
    rows = scratch.save(sketch_documents(source, params), "sketches")
    ranked = rows.where("node is not null and doc_id is not null")
    classes = scratch.save(ranked.groupBy("node", "check").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key")), "classes")
    w = params.words

    def texts_for(nodes: DataFrame) -> DataFrame:
        wanted = small_side(classes.join(nodes, "node").select("node", "text_key"))
        return source.select("text_key", "text").join(wanted, "text_key").select("node", "text")

    hashes = lambda t: (shingle_hashes(words_of(t), w) >> np.uint64(32)).astype(np.uint32)
    parts = near_components(ranked, texts_for, lambda t: shingles(t, w), hashes, params.banding, scratch)
    linked = small_side(parts.select(F.explode(F.array("node", "component")).alias("node"), "component").distinct())
    near = classes.join(linked, "node").select("node", "check", "first_id", "component")
    least = near.groupBy("component").agg(F.min("first_id").alias("component_id"))
    moved = small_side(near.join(small_side(least), "component").select("node", "check", "component_id"))
    named = classes.join(moved, ["node", "check"], "left").select("node", "check", F.coalesce("component_id", "first_id").alias("component_id"))
    named = scratch.save(named, "named")
    scratch.drop("classes", "components")
    out = rows.select("doc_id", "n", "node", "check", "text_key").join(named, ["node", "check"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), "text_key")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key")


def keep_one(docs: DataFrame, params: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns stay as they are.

    Texts without words and rows with a null id stay. Rows that share the kept
    id and belong to the component stay together; another text under an id is
    a document of its own.
    """
    scratch = Scratch(docs.sparkSession, "near")
    gone = minhash_dedup(docs, params, id_col, text_col).where("not kept").select("doc_id", "text_key").distinct()
    gone = scratch.save(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")), "gone")
    key = fresh(docs, "row_key")
    marked = docs.withColumn(key, F.xxhash64(docs[f"`{id_col}`"], docs[f"`{text_col}`"]))
    return marked.join(small_side(gone), (marked[f"`{id_col}`"] == gone["gone_id"]) & (marked[key] == gone["gone_key"]), "left_anti").drop(key)
