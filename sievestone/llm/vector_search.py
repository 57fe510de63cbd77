"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Vectors are dealt to the nearest of a bounded number of pivots, and the cells so
made cut into shards, each with a tree. A query first searches its nearest cell;
the k-th distance found there rules out, by the triangle inequality, all cells
that lie further off than it, before a tree of theirs is opened.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, grouped, own_columns

SHARD_ROWS = 4096
#: Most pivots, for all lengths of vectors together, drawn from that many times PIVOT_POOL sampled rows; every row is indexed.
CELLS, PIVOT_POOL = 1024, 4
BLOCK_QUERIES = 256
LEAF = 64
_NODE = np.dtype([("point", "<i4"), ("radius", "<f8"), ("near", "<i4"), ("far", "<i4"), ("start", "<i4"), ("end", "<i4")])


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v: vectors with components, all finite and not all zero, as doubles."""
    v = vectors.select("vec_id", F.col("v").cast("array<double>").alias("v"))
    sound = "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    return v.where(sound)


def distances(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed component by component."""
    d = points - q
    d *= d
    return np.sqrt(np.add.accumulate(d, axis=1)[:, -1])


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the order of points: a node's vantage point parts the rest at the median distance; equal points stay in one leaf."""
    rng = np.random.default_rng(len(points))
    nodes: list[list] = []
    order = np.arange(len(points))
    todo = [(0, len(points), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        nodes.append([-1, 0.0, -1, -1, start, end])
        if end - start <= LEAF:
            continue
        own = order[start:end]
        for _ in range(3):
            point = own[rng.integers(len(own))]
            d = distances(points[own], points[point])
            radius = float(np.median(d))
            near = d <= radius
            if near.all():
                near = d < radius
            if near.any() and not near.all():
                order[start:end] = np.concatenate([own[near], own[~near]])
                nodes[me][:2] = [int(point), radius if (d <= radius).sum() == near.sum() else float(d[near].max())]
                middle = start + int(near.sum())
                todo += [(start, middle, me, 0), (middle, end, me, 1)]
                break
    return np.array([tuple(n) for n in nodes], _NODE), order


def search(nodes: np.ndarray, points: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, relax: float, tau: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest points of other ids within ``tau``, nearest first, ties to the smaller id.

    ``points`` and ``ids`` lie in tree order. A branch is left out if its least
    possible distance, times ``relax``, exceeds the k-th best: 1 is exact, more
    prunes more.
    """
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    todo = [(0.0, 0)]
    while todo:
        bound, at = todo.pop()
        if bound * relax > tau * (1 + 1e-9) + 1e-12:
            continue
        point, radius, near, far, start, end = nodes[at].item()
        if point < 0:
            d = distances(points[start:end], q)
            keep = np.flatnonzero((d <= tau) & (ids[start:end] != own))
            if len(keep):
                best_d, best_i = np.concatenate([best_d, d[keep]]), np.concatenate([best_i, ids[start:end][keep]])
                order = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[order], best_i[order]
                if len(best_d) == k:
                    tau = min(tau, best_d[-1])
            continue
        d = float(distances(points[point : point + 1], q)[0])
        branches = [(max(bound, d - radius), near), (max(bound, radius - d), far)]
        todo += branches[::-1] if d <= radius else branches
    return best_d, best_i


class Cells:
    """Pivots by length of vectors; once rows are dealt, of each cell its radius about the pivot, rows and shards."""

    def __init__(self, sample: list[list[float]], cells: int):
        self.pivots: dict[int, np.ndarray] = {}
        share = cells / max(1, len(sample))
        for n in sorted({len(v) for v in sample}):
            own = np.unique(np.array([v for v in sample if len(v) == n], np.float64), axis=0)
            most = max(1, int(share * sum(len(v) == n for v in sample)))
            self.pivots[n] = own[np.random.default_rng(n).permutation(len(own))[:most]]
        self.known: dict[tuple[int, int], tuple[float, int, int]] = {}

    def deal(self, v: np.ndarray) -> tuple[int, float]:
        """The cell of a vector and its distance to the pivot; lengths without pivots have one cell of any radius."""
        if (pivots := self.pivots.get(len(v))) is None:
            return 0, np.inf
        d = distances(pivots, v)
        return int(d.argmin()), float(d.min())

    def near(self, q: np.ndarray, own: int, k: int) -> list[int]:
        """The nearest cells that together have over k rows."""
        size, rows, out = len(q), 0, []
        order = np.argsort(distances(self.pivots[size], q), kind="stable") if size in self.pivots else [0]
        for cell in map(int, order):
            if (known := self.known.get((size, cell))) is not None:
                out.append(cell)
                rows += known[1]
                if rows > k:
                    break
        return out

    def within(self, q: np.ndarray, tau: float, relax: float) -> list[int]:
        """The cells whose nearest point may lie within ``tau``; ``relax`` over 1 leaves more of them out."""
        size = len(q)
        d = distances(self.pivots[size], q) if size in self.pivots else np.zeros(1)
        return [c for c in range(len(d)) if (known := self.known.get((size, c))) is not None and (d[c] - known[0]) * relax <= tau * (1 + 1e-9) + 1e-9 * (1 + d[c])]


def index_vectors(vectors: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, Cells]:
    """A row for each shard (size, cell, shard): ids, vectors and tree; and the cells.

    Rows of a cell are dealt to its shards by row number, so that a cell of very
    many copies is spread like any other.
    """
    count = vectors.count()
    few = max(1, min(CELLS, -(-count // shard_rows)))
    pool = vectors.orderBy(F.xxhash64("vec_id", F.lit(5))).limit(PIVOT_POOL * few).select("v")  # a bounded sample
    cells = Cells([r["v"] for r in pool.collect()], few)

    def deal(batches):
        for batch in batches:
            found = [(len(v), *cells.deal(np.array(v, np.float64))) for v in batch.column(1).to_pylist()]
            size, cell, far = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(cell, pa.int32()), pa.array(far, pa.float64())], ["vec_id", "v", "size", "cell", "far"])

    dealt = scratch.save(vectors.mapInArrow(deal, "vec_id long, v array<double>, size int, cell int, far double").withColumn("row", F.monotonically_increasing_id()), "dealt")
    for r in dealt.groupBy("size", "cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row for each pivot, or length without
        cells.known[r["size"], r["cell"]] = (r["far"], r["n"], -(-r["n"] // shard_rows))
    shards = vectors.sparkSession.createDataFrame([(n, c, s) for (n, c), (_, _, s) in cells.known.items()], "size int, cell int, shards long")
    dealt = dealt.join(F.broadcast(shards), ["size", "cell"]).withColumn("shard", F.pmod(F.xxhash64("row"), "shards").cast("int"))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        points, ids = np.array(pdf["v"].tolist(), np.float64), pdf["vec_id"].to_numpy(np.int64)
        nodes, order = build(points)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        inner = nodes["point"] >= 0
        nodes["point"][inner] = place[nodes["point"][inner]]
        key = [int(pdf[c].iloc[0]) for c in ("size", "cell", "shard")]
        return pd.DataFrame([(*key, ids[order].astype("<i8").tobytes(), points[order].astype("<f8").tobytes(), nodes.tobytes())], columns=["size", "cell", "shard", "ids", "points", "nodes"])

    planted = dealt.groupBy("size", "cell", "shard").applyInPandas(plant, "size int, cell int, shard int, ids binary, points binary, nodes binary")
    return scratch.save(planted, "index"), cells


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, relax: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest vectors of other ids for every query: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance in double precision on the original vectors;
    ties go to the smaller id, and fewer candidates than k are all returned.
    Vectors and queries that are null, empty, zero or hold null or non-finite
    components take no part; vectors of another length than the query's are no
    candidates. Repeated ids are candidates of their own; of a query id that is
    repeated, one vector is asked, the smallest. ``relax`` 1 searches exactly. Of
    each shard's answers k a query are shuffled.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    index, cells = index_vectors(valid(own_columns(vectors, vec_id=id_col, v=vector_col)), scratch, shard_rows)
    asked = valid(own_columns(queries, vec_id=id_col, v=vector_col)).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = scratch.save(asked.withColumn("tau", F.lit(float("inf"))), "queries")
    route = "size int, cell int, shard int, salt int, query_id long, v array<double>, tau double"

    def routed(batches, second: bool):
        for batch in batches:
            out: list[tuple] = []
            for i, v, tau in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                q = np.array(v, np.float64)
                first = cells.near(q, i, k)
                for cell in (c for c in cells.within(q, tau, relax) if c not in first) if second else first:
                    out += [(len(q), cell, shard, i % 64, i, v, tau) for shard in range(cells.known[len(q), cell][2])]
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int32()] * 4 + [pa.int64(), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["size", "cell", "shard", "salt", "query_id", "v", "tau"])

    def blocks(batches):
        for g in grouped(batches, 4):
            for at in range(0, g.num_rows, BLOCK_QUERIES):
                part = g.slice(at, BLOCK_QUERIES)
                one = [c.slice(0, 1) for c in part.columns[:3]]
                packed = [part.column(4).to_numpy().astype("<i8"), part.column(5).flatten().to_numpy().astype("<f8"), part.column(6).to_numpy().astype("<f8")]
                yield pa.RecordBatch.from_arrays([*one, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["size", "cell", "shard", "query_ids", "queries", "taus"])

    def answer(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = r["size"]
                ids, points, nodes = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["points"], "<f8").reshape(-1, n), np.frombuffer(r["nodes"], _NODE)
                asked_ids, asked, taus = np.frombuffer(r["query_ids"], "<i8"), np.frombuffer(r["queries"], "<f8").reshape(-1, n), np.frombuffer(r["taus"])
                q, v, d = [], [], []
                for i in range(len(asked)):
                    best, who = search(nodes, points, ids, asked[i], asked_ids[i], k, relax, taus[i])
                    q.append(np.full(len(who), asked_ids[i]))
                    v.append(who)
                    d.append(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, v, d)], ["query_id", "vec_id", "score"])

    def ask(rows: DataFrame, second: bool) -> DataFrame:
        keys = ["size", "cell", "shard"]
        dealt = rows.mapInArrow(lambda batches: routed(batches, second), route).repartition(*keys, "salt").sortWithinPartitions(*keys, "salt")
        packed = dealt.mapInArrow(blocks, "size int, cell int, shard int, query_ids binary, queries binary, taus binary")
        return packed.join(index, keys).select("size", "ids", "points", "nodes", "query_ids", "queries", "taus").mapInArrow(answer, "query_id long, vec_id long, score double")

    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    first = scratch.save(best(ask(asked, False)), "first")
    far = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    known = asked.join(far, "vec_id", "left").select("vec_id", "v", F.coalesce("kth", "tau").alias("tau"))
    found = first.select("query_id", "vec_id", "score").unionByName(ask(known, True))
    return best(found).select("query_id", "rank", "vec_id", "score")
