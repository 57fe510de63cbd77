"""What the operators of this subpackage share: the working folder, bounded broadcasts, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Rows of a few numbers that a broadcast side may have, some 30 MB; larger sides are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: While a working table is written, shuffle files go with the job that wrote them.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Bytes of an Arrow batch; Spark's own 64 MB, held several times over by an executor and its Python workers, cost most of their memory.
BATCH, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH``, where its user has left them at Spark's default."""
    if spark.conf.get(BATCH_SETTING) in ("64MB", "64m", "67108864b", "67108864"):
        spark.conf.set(BATCH_SETTING, BATCH)


class Scratch:
    """Tables written to the shared folder that ``spark.checkpoint.dir`` names.

    Every table is a committed Parquet folder, so a lost executor costs only
    the tasks it was running. The folder is read from the session; a local one
    is set only where the session has none, as in tests.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="sievestone-")
            spark.sparkContext.setCheckpointDir(root)
        small_batches(spark)
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        path, conf = f"{self.path}/{name}", self.spark.conf
        before = {k: conf.get(k, None) for k in WRITING}
        try:
            for k, v in WRITING.items():
                conf.set(k, v)
            df.write.options(**options).parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v) if v is not None else conf.unset(k)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def own_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own; clashing extra columns go."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, width: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, or ``width`` sums to no more, as counted; else as it is."""
    if width is None:
        return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_key() -> Column:
    """Of the columns doc_id and text: a row's identity where ids repeat or are null. Rows of equal id and text share it."""
    return F.xxhash64("doc_id", "text")


@F.arrow_udf(StringType())
def cut_spans(texts: pa.Array, spans: pa.Array, in_bytes: pa.Array) -> pa.Array:
    """Texts without spans (start, end), in ascending order, of bytes in UTF-8 or of characters; a null list leaves a text as it is."""
    out = []
    for text, cuts, raw in zip(texts, spans, in_bytes, strict=True):
        whole = text.as_py()
        if text.is_valid and cuts.is_valid:
            source = whole.encode("utf-8", "surrogatepass") if raw.as_py() else whole
            parts, at = [], 0
            for s in cuts.as_py():
                parts.append(source[at : s["start"]])
                at = s["end"]
            whole = source[:0].join([*parts, source[at:]])
            whole = whole.decode("utf-8", "replace") if raw.as_py() else whole
        out.append(whole)
    return pa.array(out, pa.string())


def give_back() -> None:
    """Hand memory that earlier tasks of this worker process have freed back to the system; its allocators would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU library


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 1024, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows and, but for single longer texts, ``size`` bytes of a text column."""
    give_back()
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """The groups of rows that agree in the first ``by`` columns, numbers without nulls; rows come sorted by them."""
    give_back()
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(by)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and (last != keys[lo]).any():
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.concat_batches(held)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", most: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large and small stars.

    ``edges`` has columns a and b of one orderable type. Returns (node, component)
    for nodes whose component, the smallest node reachable, is not the node
    itself. Rounds are written tables; their number grows with the logarithm of
    the longest path. Hubs cost no more than their links: minima are aggregated
    before the shuffle and skewed joins are split by adaptive execution. Null
    ends and loops are ignored; no edges give no rows.
    """
    now = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    now = scratch.save(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before = None
    for k in range(1, most + 1):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        now = scratch.save(small.where("a <> b").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
