"""Near-duplicate sets: banded MinHash candidates, b-bit estimates, exact checks, components.

Used for documents (word shingles) and for lines (character shingles). A node
is one distinct set, named by a 64-bit digest of it, so equal sets need no join
to become one. Nothing is capped:

1. Bands are aggregated to buckets before the shuffle: smallest and largest
   node and the bits of all of them. A bucket of two nodes, by far the most
   common kind, is a candidate pair; only of wider buckets are members looked up.
2. In a wide bucket packed b-bit signatures give all similarities, and the
   maximum spanning forest of those that are near leaves it: fewer pairs than
   members. Pairs are confirmed on full sets and give a first partition.
3. Where a bucket still holds several parts, members that some estimate calls
   near a member of another part bring their hashed sets, and links between
   parts are found exactly, then confirmed.

Buckets of more than ``LIMIT`` members are dealt into blocks. In step 3 only
members outside a bucket's largest part meet all its members, block by block,
however many they are: what is found doesn't depend on a bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, grouped, slices, small_side

LIMIT = 1024
WIDE = 2048  # values that are counted at a time
SMALL = 48  # groups of up to so many rows are compared many at a time
BITS = 4  # of each minimum that a signature keeps: sixteen minima to a long
PAIRS = "a long, b long"


@dataclass(frozen=True)
class Banding:
    """MinHash parameters: bands * rows must be a multiple of 16.

    A pair of similarity s shares a band with probability
    1 - (1 - s^rows)^bands. ``slack`` is how far below the threshold an
    estimate may lie before its pair is dismissed; 0.12 is over three standard
    deviations for 160 minima.
    """

    percent: int = 80
    bands: int = 32
    rows: int = 5
    slack: float = 0.12
    seed: int = 20261

    @property
    def longs(self) -> int:
        return self.bands * self.rows // 16

    @property
    def least_matches(self) -> int:
        k = self.bands * self.rows
        chance = 1 / (1 << BITS)
        return int(np.floor(k * (chance + (1 - chance) * max(0.0, self.percent / 100 - self.slack))))

    @property
    def least_size(self) -> int:
        """The smallest set that can link with a different set."""
        if self.percent >= 100:
            return 1 << 30
        return max(1, -(-self.percent // (100 - self.percent)))

    def sketcher(self) -> "Sketcher":
        return Sketcher(self)


class Sketcher:
    """Bands and packed signatures of many sets of 32-bit hashes, laid end to end."""

    def __init__(self, p: Banding):
        rng = np.random.default_rng(p.seed)
        k = p.bands * p.rows
        self.p, self.k = p, k
        self.a = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
        self.mix = rng.integers(0, 1 << 63, (p.bands, p.rows), dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, p.bands, dtype=np.uint64)
        self.shift = np.arange(16, dtype=np.uint64) * np.uint64(BITS)

    def minima(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts = np.cumsum(sizes) - sizes
        out = np.empty((self.k, len(sizes)), np.uint32)
        chunk = starts >> 15  # chunks that stay in a core's cache, but for longer sets
        edges = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1), len(sizes)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            h, at = hashes[starts[lo] : starts[hi - 1] + sizes[hi - 1]], starts[lo:hi] - starts[lo]
            held = np.empty_like(h)
            for i in range(self.k):
                np.multiply(h, self.a[i], out=held)
                np.add(held, self.b[i], out=held)
                out[i, lo:hi] = np.minimum.reduceat(held, at)
        return finish32(out.T)

    def __call__(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bands and signatures, a row for each set; no set is empty."""
        if not len(sizes):
            return np.zeros((0, self.p.bands), np.int64), np.zeros((0, self.p.longs), np.int64)
        m = self.minima(hashes, sizes).astype(np.uint64)
        keys = finish64((m.reshape(-1, *self.mix.shape) * self.mix).sum(axis=2) + self.salt)
        sig = ((m & np.uint64((1 << BITS) - 1)).reshape(len(m), -1, 16) << self.shift).sum(axis=2)
        return keys.view(np.int64), sig.view(np.int64)


def finish32(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    h = h ^ (h >> np.uint32(12))
    h = h * np.uint32(0x297A2D39)
    return h ^ (h >> np.uint32(15))


def finish64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order, by a sort, which is far faster here than NumPy's hash table."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def as_long(x: int) -> int:
    """The 64-bit number whose bits a signed long has."""
    return x - (1 << 64) if x >> 63 else x


def long_lists(which: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """An Arrow list column: the rows of a matrix where ``which`` is true, else null."""
    width = rows.shape[1]
    ends = np.concatenate([[0], np.cumsum(which) * width]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()), mask=pa.array(~which))


def matches(x: str, y: str, longs: int) -> Column:
    """Equal b-bit minima of two signatures, by bit counts of their differences."""
    unequal = F.lit(0)
    for i in range(longs):
        d = F.expr(f"{x}[{i}] ^ {y}[{i}]")
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        unequal = unequal + F.bit_count(d)
    return F.lit(longs * 16) - unequal


def estimate(equal: int, minima: int) -> float:
    """Similarity from equal b-bit minima, corrected for chance collisions."""
    chance = 1 / (1 << BITS)
    return max(0.0, (equal / minima - chance) / (1 - chance))


def close_enough(p: Banding, x: str, y: str) -> Column:
    """Whether sizes and signatures allow a link between rows x and y."""
    sizes = F.expr(f"100 * least({x}.n, {y}.n) >= {p.percent} * greatest({x}.n, {y}.n)")
    return sizes & (matches(f"{x}.sig", f"{y}.sig", p.longs) >= p.least_matches)


def nearness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], p: Banding) -> np.ndarray:
    """Equal b-bit minima of each row of x with each of y, -1 where sizes or signatures rule a link out; rows are (sizes, signatures)."""
    (n, s), (m, t) = x, y
    ones = np.uint64(0x1111111111111111)
    equal = np.full((len(n), len(m)), 16 * p.longs, np.int16)
    for i in range(p.longs):
        d = s[:, i, None] ^ t[None, :, i]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        equal -= np.bitwise_count(d & ones)
    small, large = np.minimum(n[:, None], m[None, :]), np.maximum(n[:, None], m[None, :])
    equal[(equal < p.least_matches) | (100 * small < p.percent * large)] = -1
    return equal


def in_small_groups(group: np.ndarray, n: np.ndarray, sig: np.ndarray, p: Banding) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one group, and their equal minima, that sizes and signatures allow to link; rows of a group lie together."""
    a, b, equal = [], [], []
    ones = np.uint64(0x1111111111111111)
    for step in range(1, int(np.bincount(group).max(initial=0))):
        i = np.flatnonzero(group[step:] == group[:-step])
        j = i + step
        fits = 100 * np.minimum(n[i], n[j]) >= p.percent * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        d = sig[i] ^ sig[j]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        same = 16 * p.longs - np.bitwise_count(d & ones).sum(axis=1, dtype=np.int64)
        near = same >= p.least_matches
        a.append(i[near])
        b.append(j[near])
        equal.append(same[near])
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x + empty) for x in (a, b, equal))


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[list[int], list[int]]:
    """Of edges between numbered rows a maximum spanning forest."""
    parent: dict[int, int] = {}
    out_a, out_b = [], []
    order = np.argsort(-weight, kind="stable")
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = i, j
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        while (up := parent.setdefault(y, y)) != y:
            parent[y] = y = parent[up]
        if x != y:
            parent[x] = y
            out_a.append(i)
            out_b.append(j)
    return out_a, out_b


def gathered(batches: Iterator[pa.RecordBatch], by: int, most: int = 2000) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
    """Groups of more than ``SMALL`` rows one by one, with None; smaller ones many to a batch, with each row's group number."""
    held: list[pa.RecordBatch] = []
    sizes: list[int] = []
    for g in grouped(batches, by):
        if g.num_rows > SMALL:
            yield g, None
            continue
        held.append(g)
        sizes.append(g.num_rows)
        if len(held) >= most:
            yield pa.concat_batches(held), np.repeat(np.arange(len(sizes)), sizes)
            held, sizes = [], []
    if held:
        yield pa.concat_batches(held), np.repeat(np.arange(len(sizes)), sizes)


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a maximum spanning forest of a symmetric matrix; entries below 0 are no edges."""
    size = len(near)
    best, via = np.full(size, -1, near.dtype), np.zeros(size, np.int64)
    out, a, b = np.ones(size, bool), [], []
    for _ in range(size):
        i = int(np.argmax(np.where(out, best, -2)))
        if best[i] >= 0:
            a.append(via[i])
            b.append(i)
        out[i] = False
        better = near[i] > best
        best[better], via[better] = near[i][better], i
    return np.array(a, np.int64), np.array(b, np.int64)


def pair_batch(a, b) -> pa.RecordBatch:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def signatures(column: pa.Array, p: Banding) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, p.longs)


def in_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows dealt by the columns ``by`` and sorted by them, for ``grouped``."""
    return rows.repartition(*by).sortWithinPartitions(*by)


def confirmed(pairs: DataFrame, texts: DataFrame, sets: Callable[[str], set], percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def check(batches):
        held: dict[int, set] = {}
        for batch in slices(slices(batches, 2), 3):
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for x, s, t in zip(a, batch.column(2), batch.column(3), strict=True):
                if x not in held:
                    if len(held) >= 64:
                        held.clear()
                    held[x] = sets(s.as_py())
                s, t = held[x], sets(t.as_py())
                both = len(s & t)
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pair_batch([x for x, k in zip(a, keep, strict=True) if k], [x for x, k in zip(b, keep, strict=True) if k])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, PAIRS)


def _wide_pairs(members: DataFrame, buckets: DataFrame, sigs: DataFrame, p: Banding) -> DataFrame:
    """Of each wide bucket, or each block of ``LIMIT`` of its members and its smallest one, the spanning forest of near members."""
    counts = members.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > LIMIT)
    counts = counts.join(buckets, "key").select("key", F.ceil(F.col("members") / LIMIT).cast("int").alias("blocks"), "low")
    counts = small_side(counts)
    dealt = members.join(counts.drop("low"), "key", "left").select("key", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "blocks")).cast("int").alias("block"), "node")
    heads = counts.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("low").alias("node"))
    rows = dealt.unionByName(heads).join(sigs, "node").select("key", "block", "node", "n", "sig")

    def span(batches):
        for g, group in gathered(batches, 2):
            node, n, sig = g.column(2).to_numpy(), g.column(3).to_numpy().astype(np.int64), signatures(g.column(4), p)
            a, b = forest(nearness((n, sig), (n, sig), p)) if group is None else spanning(*in_small_groups(group, n, sig, p))
            yield pair_batch(node[np.asarray(a, np.int64)], node[np.asarray(b, np.int64)])

    return in_groups(rows, ["key", "block"]).mapInArrow(span, PAIRS).where("a < b").distinct()


def _open_rows(placed: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with the bucket's largest one, its members and those outside the largest."""
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("rows"))
    several = counts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("rows").alias("members"), F.max(F.struct("rows", "component")).alias("most"))
    several = several.where("parts > 1").select("key", F.col("most.component").alias("largest"), "members", (F.col("members") - F.col("most.rows")).alias("minors"))
    return placed.join(small_side(several), "key")


def _across(members: DataFrame, parts: DataFrame, sigs: DataFrame, texts_for: Callable[[DataFrame], DataFrame], hashes: Callable[[str], np.ndarray], p: Banding, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that join different parts of a bucket: of the links on hashed sets, a maximum spanning forest over the parts."""
    placed = members.join(small_side(parts), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    rows = scratch.save(_open_rows(placed).join(sigs, "node").select("key", "node", "component", "n", "sig", "largest", "members", "minors"), "open")
    block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    rows = rows.select("key", "node", "component", "n", "sig", (F.col("component") != F.col("largest")).alias("minor"), *(F.ceil(F.col(c) / LIMIT).cast("int").alias(c) for c in ("members", "minors")))
    whole = rows.where("members = 1 and minors = 1").withColumns({"x": F.lit(0), "y": F.lit(0), "side": F.lit(2)})
    rows = rows.where("members > 1 or minors > 1")
    every = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("minors") - 1))).withColumn("y", block("members", 1)).withColumn("side", F.lit(0))
    minor = rows.where("minor").withColumn("x", block("minors", 2)).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("members") - 1))).withColumn("side", F.lit(1))
    met = whole.select(every.columns).unionByName(every).unionByName(minor).select("key", "x", "y", "side", "node", "component", "n", "sig")

    def near(batches):
        for g, group in gathered(batches, 3):
            side, part = g.column(3).to_numpy(), g.column(5).to_numpy()
            n, sig = g.column(6).to_numpy().astype(np.int64), signatures(g.column(7), p)
            if group is None:
                x, y = np.flatnonzero(side > 0), np.flatnonzero(side != 1)
                hit = nearness((n[x], sig[x]), (n[y], sig[y]), p) >= 0
                hit &= part[x][:, None] != part[y][None, :]
                chosen = distinct(np.concatenate([x[hit.any(axis=1)], y[hit.any(axis=0)]]))
            else:
                a, b, _ = in_small_groups(group, n, sig, p)
                cross = (part[a] != part[b]) & ((side[a] == 2) | (side[a] != side[b]))
                chosen = distinct(np.concatenate([a[cross], b[cross]]))
            if len(chosen):
                yield g.take(pa.array(chosen)).select(["key", "x", "y", "side", "node", "component"])

    found = scratch.save(in_groups(met, ["key", "x", "y"]).mapInArrow(near, "key long, x int, y int, side int, node long, component long"), "near")

    def hashed(batches):
        for batch in slices(batches, 1):
            own = [hashes(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["node", "set"])

    own = scratch.save(texts_for(found.select("node").distinct()).mapInArrow(hashed, "node long, set binary"), "sets")
    rows = found.join(own, "node").select("key", "x", "y", "side", "node", "component", "set")

    def link(batches):
        for g, group in gathered(batches, 3, most=500):
            columns = g.column(3).to_numpy(), g.column(4).to_numpy(), g.column(5).to_numpy(), [np.frombuffer(s.as_buffer(), np.uint32) for s in g.column(6)], p.percent
            yield pair_batch(*(linked_parts(*columns) if group is None else linked_in_small_groups(group, *columns)))

    pairs = in_groups(rows, ["key", "x", "y"]).mapInArrow(link, PAIRS).where("a < b").distinct()
    return scratch.save(pairs, "pairs-2")


def linked_parts(side: np.ndarray, node: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Of the pairs of different parts and 100 * intersection >= percent * union, a maximum spanning forest over the parts.

    Rows of side 1 meet those of side 0; rows of side 2 meet each other.
    """
    sizes = np.array([len(s) for s in sets])
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, held = np.repeat(np.arange(len(sets)), sizes), often[at] > 1
    row, column = row[held], (np.cumsum(often > 1) - 1)[at[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    x, y = np.flatnonzero(side > 0), np.flatnonzero(side != 1)
    both = np.zeros((len(x), len(y)), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):  # values that several sets have, ``WIDE`` at a time
        own = slice(*np.searchsorted(column, [lo, lo + WIDE]))
        has = np.zeros((len(sets), WIDE), np.float32)
        has[row[own], column[own] - lo] = 1
        both += (has[x] @ has[y].T).astype(np.int64)
    union = sizes[x][:, None] + sizes[y][None, :] - both
    i, j = np.nonzero((part[x][:, None] != part[y][None, :]) & (100 * both >= percent * union))
    ratio, i, j = -both[i, j] / union[i, j], x[i], y[j]
    found = list(zip(ratio.tolist(), node[i].tolist(), node[j].tolist(), part[i].tolist(), part[j].tolist(), strict=True))
    return _tree(found)


def shared(group: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows of one group whose sets meet, and how many values they share; rows of a group lie together, groups are numbered from 0."""
    rows = np.bincount(group)
    first, square = np.cumsum(rows) - rows, np.cumsum(rows**2) - rows**2
    row = np.repeat(np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets)))
    key = (group[row].astype(np.uint64) << np.uint64(38)) | (np.concatenate(sets).astype(np.uint64) << np.uint64(6)) | (row - first[group[row]]).astype(np.uint64)
    key = np.sort(key)  # of a group, a value and the row's place there, which ``SMALL`` keeps to six bits
    row = first[(key >> np.uint64(38)).astype(np.int64)] + (key & np.uint64(63)).astype(np.int64)
    key >>= np.uint64(6)
    both = np.zeros(int((rows**2).sum()), np.int64)
    for step in range(1, int(rows.max())):
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        i, j = row[same], row[same + step]
        g = group[i]
        both += np.bincount(square[g] + (i - first[g]) * rows[g] + j - first[g], minlength=len(both))
    at = np.flatnonzero(both)
    g = np.searchsorted(square, at, side="right") - 1
    i, j = np.divmod(at - square[g], rows[g])
    return first[g] + i, first[g] + j, both[at]


def linked_in_small_groups(group: np.ndarray, side: np.ndarray, node: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """``linked_parts`` of many groups at once."""
    i, j, both = shared(group, sets)
    sizes = np.array([len(s) for s in sets])
    union = sizes[i] + sizes[j] - both
    holds = (part[i] != part[j]) & (100 * both >= percent * union) & ((side[i] == 2) | (side[i] != side[j]))
    i, j, both, union = i[holds], j[holds], both[holds], union[holds]
    x, y = np.where((side[i] == 1) | ((side[i] == 2) & (node[i] < node[j])), (i, j), (j, i))
    of = group[x].tolist()
    return _tree(list(zip((-both / union).tolist(), node[x].tolist(), node[y].tolist(), zip(of, part[x].tolist()), zip(of, part[y].tolist()), strict=True)))


def _tree(found: list[tuple]) -> tuple[list[int], list[int]]:
    """Of links (weight, node, node, part, part) those of a minimum spanning forest over the parts."""
    parent: dict = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for _, x, y, p, q in sorted(found):
        if (p := root(p)) != (q := root(q)):
            parent[p] = q
            a.append(x)
            b.append(y)
    return a, b


def near_components(sketches: DataFrame, texts_for: Callable[[DataFrame], DataFrame], sets: Callable[[str], set], hashes: Callable[[str], np.ndarray], p: Banding, scratch: Scratch) -> DataFrame:
    """Components over all pairs of similarity >= percent that share a band: (node, component) of nodes that are not their component's smallest.

    ``sketches``: node long, n int, bands array<long>, sig array<long>; rows that
    repeat a node, or have no bands, are allowed. ``texts_for`` gives (node, text)
    for a table of nodes, repeats allowed; ``sets`` and ``hashes`` a text's set
    and its distinct 32-bit hashes.
    """
    keys = sketches.where("bands is not null").select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.bit_or("node").alias("bits")).where("low < high")
    buckets = scratch.save(buckets, "buckets")
    two = F.col("bits") == F.col("low").bitwiseOR(F.col("high"))  # a third random node adds a bit, but for odds of (3/4)^64
    pairs = scratch.save(buckets.where(two).select(F.col("low").alias("a"), F.col("high").alias("b")).distinct(), "twos")
    members = scratch.save(keys.join(small_side(buckets.where(~two).select("key")), "key").distinct(), "members")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct()
    sigs = sketches.where("bands is not null").select("node", "n", "sig").join(small_side(nodes), "node", "left_semi")
    sigs = scratch.save(sigs.dropDuplicates(["node"]), "sigs")
    x, y = (sigs.select(F.struct(F.col("node").alias(c), "n", "sig").alias(f"s{c}")) for c in "ab")
    close = pairs.join(x, F.col("a") == F.col("sa.a")).join(y, F.col("b") == F.col("sb.b")).where(close_enough(p, "sa", "sb")).select("a", "b")
    pairs = scratch.save(close.union(_wide_pairs(members, buckets, sigs, p)).distinct(), "pairs-1")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        texts = scratch.save(texts_for(ends), f"texts-{name}")
        found = scratch.save(confirmed(pairs, texts, sets, p.percent), f"links-{name}")
        scratch.drop(f"texts-{name}")
        return found

    first = connected_components(links(pairs, "1"), scratch, "parts-1")
    more = links(_across(members, first, sigs, texts_for, hashes, p, scratch), "2")
    named = small_side(first)
    for end in ("a", "b"):  # what is left joins components of the first partition
        more = more.join(named.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")), end, "left")
    second = connected_components(more.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")), scratch, "parts-2")
    joined = first.join(second.withColumnRenamed("node", "part").withColumnRenamed("component", "whole"), F.col("component") == F.col("part"), "left")
    out = joined.select("node", F.coalesce("whole", "component").alias("component")).unionByName(second.join(first, "node", "left_anti"))
    scratch.drop("buckets", "twos", "members", "sigs", "open", "near", "sets")
    return scratch.save(out, "components")
