"""Duplicate rows and vectors: exact groups, pairs, pointers, near pairs, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.exprs import cosine, dot, row_hash, row_text, zero_filled
from ..functions.working import written


def hashed(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(key, row_hash(columns).alias("hash"))


def exact_groups(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """hash, first_key, members of every group of equal rows. What a hot group costs is one counter a task."""
    groups = hashed(df, key, columns).groupBy("hash").agg(F.min(key).alias("first_key"), F.count("*").alias("members"))
    return groups.where("members > 1")


def exact_pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key1 < key2 that stand for all pairs of equal rows: each row of a group of ``members`` with the group's least key.

    Any two rows with one key1, and key1 itself, are a pair; a group of k rows
    takes k - 1 rows, not k (k - 1) / 2.
    """
    rows = hashed(df, key, columns)
    pairs = rows.join(exact_groups(df, key, columns), "hash").where(F.col(key) > F.col("first_key"))
    return pairs.select(F.col("first_key").alias("key1"), F.col(key).alias("key2"), "members", F.lit(1.0).alias("similarity"), F.lit(True).alias("is_exact"))


def pointers(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, first_key of every row that repeats an earlier one; the least key of a group is the one not listed."""
    rows = hashed(df, key, columns)
    first = rows.groupBy("hash").agg(F.min(key).alias("first_key"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "hash").where(F.col(key) > F.col("first_key")).select(key, "first_key")


def flag_repeats(df: DataFrame, key: str, columns: list[str], out: str = "is_duplicate") -> DataFrame:
    """The table with a flag for all but the first row of each group."""
    later = pointers(df, key, columns).select(F.col(key).alias("__key"))
    joined = df.join(later, df[key] == F.col("__key"), "left")
    return joined.select(*[df[c] for c in df.columns], F.col("__key").isNotNull().alias(out))


def cross_pairs(train: DataFrame, test: DataFrame, train_key: str, test_key: str, columns: list[str]) -> DataFrame:
    """Rows of one table with an equal one in another: train_key, test_key (the least of several), test_rows, severity."""
    a = train.select(F.col(train_key).alias("train_key"), F.sha2(row_text(columns), 256).alias("hash"))
    b = test.select(F.col(test_key).alias("test_key"), F.sha2(row_text(columns), 256).alias("hash"))
    b = b.groupBy("hash").agg(F.min("test_key").alias("test_key"), F.count("*").alias("test_rows"))
    return a.join(b, "hash").select("train_key", "test_key", "test_rows", F.lit("critical").alias("severity"))


def duplicate_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """The share of rows that repeat another."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(1 - F.count("*") / F.sum("n"), F.lit(0.0)).alias("duplicate_rate"))


def unit_vectors(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, v: rows with their columns brought to 0..1 by least and greatest, and to unit length."""
    row = df.agg(*[F.struct(F.min(zero_filled(c)), F.max(zero_filled(c))).alias(c) for c in columns]).first()
    parts = [(zero_filled(c) - row[c][0]) / (row[c][1] - row[c][0]) if row[c][0] is not None and row[c][1] > row[c][0] else F.lit(0.0) for c in columns]
    v = F.array(*parts)
    length = F.sqrt(dot(F.col("v"), F.col("v")))
    return df.select(key, v.alias("v")).select(key, F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")).alias("v"))


#: Most vectors of a block, and most numbers of one; rows that the axis is chosen by; most cells along it; pairs that a task should look at, and that are sent on at once.
BLOCK_ROWS, BLOCK_NUMBERS, AXIS_SAMPLE, MOST_CELLS, TASK_PAIRS, SENT_PAIRS = 4096, 1 << 18, 4096, 1024, 1 << 26, 1 << 18


def near_pairs(vectors: DataFrame, key: str, threshold: float = 0.9, block: int = BLOCK_ROWS) -> DataFrame:
    """key1 < key2, similarity of all pairs of unit vectors with cosine >= threshold, copies too; exact, whatever the size of a group.

    Unit vectors that near lie within sqrt(2 - 2 threshold) of each other along
    every axis. The axis that tells a bounded sample apart best is cut into
    cells that wide, and a cell into blocks of bounded size; a block meets those
    of its own cell and of the next, so no pair is missed and none is met twice.
    A task holds two blocks at a time, and of what is found a bounded part.
    Rows of one key are no pair. Null keys, and vectors null, of zeros or with
    components that are no finite numbers, take no part.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("k"), F.col("v").cast("array<double>").alias("v"))
    rows = rows.where("k is not null and exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    kind = rows.schema["k"].dataType
    drawn = np.array([r["v"] for r in rows.orderBy(F.xxhash64("k", "v")).limit(AXIS_SAMPLE).select("v").collect()])
    if not len(drawn):
        return rows.select(F.col("k").alias("key1"), F.col("k").alias("key2"), F.lit(0.0).alias("similarity"))
    axis = np.linalg.svd(drawn - drawn.mean(axis=0), full_matrices=False)[2][0]
    width = max((max(0.0, 2 - 2 * threshold) + 1e-12) ** 0.5, 2 / MOST_CELLS)
    along = dot(F.col("v"), F.array(*[F.lit(float(x)) for x in axis]))
    placed = written(rows.withColumn("cell", F.floor(along / width)))
    sizes = dict(sorted(tuple(r) for r in placed.groupBy("cell").count().collect()))  # a number for each cell
    block = max(1, min(block, BLOCK_NUMBERS // max(1, drawn.shape[1])))
    parts = {c: -(-n // block) for c, n in sizes.items()}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    before = lambda c: first.get(c - 1, first[c])
    cells = spark.createDataFrame([(c, parts[c], first[c], before(c), first[c] + parts[c] + parts.get(c + 1, 0) - 1) for c in sizes], "cell long, parts int, first int, low int, high int")
    numbered = placed.join(F.broadcast(cells), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("k", "v"), F.col("parts")).cast("int"))  # a row for each cell
    looked_at = sum(n * n // 2 + n * sizes.get(c + 1, 0) for c, n in sizes.items())
    tasks = int(min(max(16, looked_at // TASK_PAIRS), sum(parts[c] * (parts[c] + parts.get(c + 1, 0)) for c in parts)))
    blocks = written(numbered.groupBy("block").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.collect_list(F.struct("k", "v")).alias("e")))
    one = blocks.select(F.col("block").alias("x"), F.explode(F.expr("sequence(block, high)")).alias("y"), F.col("e").alias("one")).repartition(tasks, "x", "y")
    two = blocks.select(F.explode(F.expr("sequence(low, block)")).alias("x"), F.col("block").alias("y"), F.col("e").alias("two")).repartition(tasks, "x", "y")

    def meet(batches):
        held, have = [], 0
        numbers = lambda rows: rows.flatten()[1].flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1)
                a, b = r.column("one").flatten(), r.column("two").flatten()
                keys, others, same = a.flatten()[0], b.flatten()[0], r.column("x")[0] == r.column("y")[0]
                u, v = numbers(a), numbers(b)
                for lo in range(0, len(u), 64):
                    s = u[lo : lo + 64] @ v.T
                    i, j = np.nonzero(s >= min(threshold, 1 - 2.0**-44))
                    if same:
                        i, j = i[i + lo < j], j[i + lo < j]
                    s = s[i, j]
                    i += lo
                    if threshold > 1 - 2.0**-44:  # rounding can keep copies apart
                        own = (s >= threshold) | (u[i] == v[j]).all(axis=1)
                        i, j, s = i[own], j[own], s[own]
                    if not len(i):
                        continue
                    p, q = keys.take(pa.array(i)), others.take(pa.array(j))
                    out = pa.RecordBatch.from_arrays([pc.min_element_wise(p, q), pc.max_element_wise(p, q), pa.array(s)], ["key1", "key2", "similarity"])
                    held.append(out.filter(pc.not_equal(p, q)))
                    have += held[-1].num_rows
                    if have >= SENT_PAIRS:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, have = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    schema = StructType([StructField("key1", kind), StructField("key2", kind), StructField("similarity", DoubleType())])
    return one.hint("merge").join(two, ["x", "y"]).select("x", "y", "one", "two").mapInArrow(meet, schema)


def components(pairs: DataFrame, folder: str, most: int = 60) -> DataFrame:
    """key, group: the least key reachable over pairs, for every key in a pair.

    Labels spread over links and jump to their label's label; every round is a
    table written below ``folder``, so lost executors cost no more than their
    tasks, and rounds grow with the logarithm of the longest path.
    """
    spark = pairs.sparkSession
    links = pairs.select(F.col("key1").alias("a"), F.col("key2").alias("b"))
    links = links.union(links.select("b", "a")).distinct()
    links.write.mode("overwrite").parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    labels = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "key")
    for k in range(most):
        labels.write.mode("overwrite").parquet(f"{folder}/labels-{k}")
        labels = spark.read.parquet(f"{folder}/labels-{k}")
        met = links.join(labels, links["b"] == labels["key"]).groupBy("a").agg(F.min("label").alias("other"))
        spread = labels.join(met, labels["key"] == met["a"]).select("key", F.least("label", "other").alias("label"))
        up = labels.select(F.col("key").alias("label"), F.col("label").alias("above"))
        jumped = spread.join(up, "label", "left").select("key", F.least("label", F.coalesce("above", "label")).alias("label"))
        jumped.write.mode("overwrite").parquet(f"{folder}/next-{k}")
        jumped = spark.read.parquet(f"{folder}/next-{k}")
        if not jumped.exceptAll(labels).limit(1).count():
            return labels.withColumnRenamed("label", "group")
        labels = jumped
    raise RuntimeError(f"groups did not settle in {most} rounds")


def similarity_of(pairs: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Pairs with the cosine of their vectors."""
    a = vectors.select(F.col(key).alias("key1"), F.col(vector).alias("v1"))
    b = vectors.select(F.col(key).alias("key2"), F.col(vector).alias("v2"))
    return pairs.join(a, "key1").join(b, "key2").select("key1", "key2", cosine(F.col("v1"), F.col("v2")).alias("similarity"))


def first_of_each(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows without repeats, the least key of each group kept, by one aggregation and one anti join."""
    return df.join(pointers(df, key, columns).select(key), key, "left_anti")


def per_chunk_repeats(df: DataFrame, key: str, columns: list[str], chunk: str) -> DataFrame:
    w = Window.partitionBy(chunk, *columns).orderBy(key)
    return df.select(key, chunk, (F.row_number().over(w) > 1).alias("is_duplicate"))
