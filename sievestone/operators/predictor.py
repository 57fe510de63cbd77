"""Quality foretold: of tables, from numbers about them, learnt from bootstrap tables; of rows, by a tree that has learnt a costlier score."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions.exprs import ratio, zero_filled
from ..functions.quantiles import quantiles
from .scores import duplicate_score, imbalance_score, outlier_score, overall

NUMBERS = ["log_rows", "missing_rate", "duplicate_rate", "mean_skew", "mean_kurtosis", "mean_correlation", "label_entropy", "imbalance_ratio", "log_classes"]


def _draws(key: str, table: Column, seed: int, most: float) -> tuple[Column, Column, Column]:
    """Whether a row lies in a table, lies in it twice, and is spoilt there."""
    size = 1 << 20
    draw = lambda salt, *more: F.pmod(F.xxhash64(key, table, *more, F.lit(seed + salt)), F.lit(size)) / size
    own = lambda salt: F.pmod(F.xxhash64(table, F.lit(seed + salt)), F.lit(size)) / size
    return draw(1) < 0.3 + 0.7 * own(2), draw(3) < most * own(4), draw(5, F.lit(0)) < most * own(6)


def bootstrap_tables(df: DataFrame, key: str, tables: int, seed: int = 42, spoil: dict[str, Column] | None = None, most: float = 0.4) -> DataFrame:
    """The rows of ``tables`` samples of a table, each with a column ``table``; how many rows and how spoilt differs from one to the next.

    A row lies in a table if its hash with the table's number says so, and more
    than once by a second hash. In a row that a third hash picks, at the table's
    own rate, columns are replaced as ``spoil`` says. The samples are made
    within rows: a row goes out as often as it is drawn, so rows are dealt
    evenly before that, in whatever files they come.
    """
    taken, twice, hit = _draws(key, F.col("table"), seed, most)
    rows = df.repartition(F.xxhash64(key)).withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    rows = rows.where(taken).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(twice, 2).otherwise(1))))
    return rows.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c, value in (spoil or {}).items()}).drop("copy")


def table_numbers(rows: DataFrame, label: str, columns: list[str], fences: dict[str, tuple[float, float]]) -> DataFrame:
    """table, ``NUMBERS``, quality of every table of ``rows``, all tables in common grouped passes.

    The quality is the overall score of repeats, values outside ``fences`` and
    class sizes. Tables are whole numbers. Different rows are counted by one group
    for all tables, which has a bit for each table that holds the row; samples
    of one row meet in its task, so the shuffle grows with the rows and hardly
    with the tables.
    """
    mean, zero = _mean, _zero
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = reduce(Column.__or__, [F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)) for c, (lo, hi) in fences.items()], F.lit(False))
    main = rows.groupBy("table").agg(
        F.count("*").alias("n"), mean([F.avg(F.col(c).isNull().cast("double")) for c in columns]).alias("missing_rate"), mean([F.abs(zero(F.skewness(c))) for c in columns]).alias("mean_skew"),
        mean([F.abs(zero(F.kurtosis(c))) for c in columns]).alias("mean_kurtosis"), (mean([F.abs(zero(F.corr(a, b))) for a, b in pairs]) if pairs else F.lit(0.0)).alias("mean_correlation"), F.count_if(out).alias("outliers"),
    )
    plain = rows.select("table", F.col(label).alias("row_label"), *[F.col(c).alias(f"column_{i}") for i, c in enumerate(columns)])  # names of our own
    bit = lambda first: F.bit_or(F.when(F.pmod("table", F.lit(128)).between(first, first + 63), F.expr("shiftleft(1L, cast(pmod(table, 64) as int))")).otherwise(F.lit(0).cast("long")))
    held = plain.groupBy(F.floor(F.col("table") / 128).alias("band"), *plain.columns[1:]).agg(bit(0).alias("low"), bit(64).alias("high"))
    held = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(127)))).where(F.expr("(shiftrightunsigned(if(k < 64, low, high), k % 64) & 1) = 1"))
    different = held.groupBy((F.col("band") * 128 + F.col("k")).alias("table")).agg(F.count("*").alias("different"))
    classes = plain.where("row_label is not null").groupBy("table", "row_label").agg(F.count("*").alias("size"))
    return _numbers(main, different, classes)


def _hash_int(value: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What ``xxhash64`` makes of an int after columns whose hash is ``before``, as in ``_draws``."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5 + 4)]
    h = (before + p[3]) ^ ((value.astype(np.uint64) & np.uint64(0xFFFFFFFF)) * p[0])
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p[1] + p[2]
    for shift, factor in ((33, p[1]), (29, p[2])):
        h ^= h >> np.uint64(shift)
        h *= factor
    return h ^ (h >> np.uint64(32))


def _matrix(hashes: np.ndarray, tables: int, seed: int, most: float) -> np.ndarray:
    """``_draws`` of rows with these hashes of their keys, a column for each table: how often it holds the row, below 0 if spoilt."""
    size = 1 << 20
    out = np.empty((len(hashes), tables), np.int8)
    table, salt = np.arange(tables), lambda k: np.array([seed + k])
    own = [(_hash_int(salt(k), _hash_int(table, np.array([42], np.uint64))) & np.uint64(size - 1)) / size for k in (2, 4, 6)]
    for at in range(0, len(hashes), 256):  # blocks that stay in a core's cache
        row = _hash_int(table, hashes[at : at + 256].view(np.uint64)[:, None])
        share = [(_hash_int(salt(k), before) & np.uint64(size - 1)) / size for k, before in ((1, row), (3, row), (5, _hash_int(np.array([0]), row)))]
        block = (share[0] < 0.3 + 0.7 * own[0]).astype(np.int8)
        block += block * (share[1] < most * own[1])
        out[at : at + 256] = np.where(share[2] < most * own[2], -block, block)
    return out


def _mean(parts: list[Column]) -> Column:
    return reduce(Column.__add__, parts) / max(1, len(parts))


def _zero(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def _numbers(main: DataFrame, different: DataFrame, classes: DataFrame) -> DataFrame:
    """table, ``NUMBERS``, quality of means and moments, counts of different rows, and sizes of classes."""
    total = classes.groupBy("table").agg(F.sum("size").alias("t"), F.max("size").alias("top"), F.min("size").alias("low"), F.count("*").alias("k"))
    p = F.col("size") / F.col("t")
    entropy = classes.join(total, "table").groupBy("table").agg(F.sum(-p * F.log2(p)).alias("label_entropy"), F.first(ratio(F.col("top"), F.col("low"))).alias("imbalance_ratio"), F.first("k").alias("k"))
    j = main.join(different, "table").withColumn("repeats", F.col("n") - F.col("different")).join(entropy, "table", "left").na.fill({"label_entropy": 0.0, "imbalance_ratio": 1.0, "k": 1})
    parts = {"duplicate": duplicate_score(F.col("repeats"), F.col("repeats"), F.col("n")), "outlier": outlier_score(F.col("outliers"), F.col("n")), "imbalance": imbalance_score(F.col("imbalance_ratio"))}
    quality = overall(parts) - 20 * F.col("missing_rate")
    return j.select("table", F.log1p("n").alias("log_rows"), "missing_rate", ratio(F.col("repeats"), F.col("n")).alias("duplicate_rate"), "mean_skew", "mean_kurtosis", "mean_correlation", "label_entropy", "imbalance_ratio", F.log1p("k").alias("log_classes"), quality.alias("quality"))


def bootstrap_numbers(df: DataFrame, key: str, tables: int, label: str, columns: list[str], fences: dict[str, tuple[float, float]], seed: int = 42, spoil: dict[str, Column] | None = None, most: float = 0.4) -> DataFrame:
    """``table_numbers`` of ``bootstrap_tables``, with a matrix of draws for each batch of rows in place of a row for each draw.

    A draw is how often a row lies in a table, below 0 if it is spoilt there;
    tasks make it from the hash of the row's key. Moments are sums of powers, about the means of the whole table,
    weighted by draws. A variance
    under 1e-11 of the mean square about those means counts as none. Different
    rows are counted by groups that have a bit for each table.
    """
    d, words, pairs = len(columns), -(-tables // 64), [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    limits = [fences.get(c) for c in columns]
    spoilt = [(spoil or {}).get(c, F.col(c)) for c in columns]
    rows = df.repartition(F.xxhash64(key)).select(F.col(label).alias("row_label"), *[F.col(c).alias(f"clean_{i}") for i, c in enumerate(columns)], *[c.alias(f"spoilt_{i}") for i, c in enumerate(spoilt)], F.xxhash64(key).alias("hash"))
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(str(i)) for i, c in enumerate(columns)]).first()
    about = [m if m is not None and math.isfinite(m) else 0.0 for m in means]

    def of(column: pa.Array) -> np.ndarray:
        return _matrix(column.to_numpy(), tables, seed, most)

    def features(x: list[pa.Array]) -> np.ndarray:
        """Of each row: 1; of each column nulls, outliers, count and powers 1 to 4; of each pair of columns count, both, both squared, product."""
        held = [c.is_valid().to_numpy(zero_copy_only=False) for c in x]
        value = [c.fill_null(m).to_numpy(zero_copy_only=False) for c, m in zip(x, about, strict=True)]
        out = [np.ones(len(held[0]))]
        for v, h, m, fence in zip(value, held, about, limits, strict=True):
            y = v - m
            out += [~h, h & ((v < fence[0]) | ~(v <= fence[1])) if fence else np.zeros(len(v)), h, y, y * y, y**3, y**4]
        for i, j in pairs:
            both = held[i] & held[j]
            a, b = np.where(both, value[i] - about[i], 0.0), np.where(both, value[j] - about[j], 0.0)
            out += [both, a, b, a * a, b * b, a * b]
        return np.stack(out, axis=1).astype(np.float64)

    def add(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                w = of(part.column(2 * d)).astype(np.float64)
                own = np.maximum(w, 0).T @ features(part.columns[:d]) + np.maximum(-w, 0).T @ features(part.columns[d : 2 * d])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(tables, dtype=np.int32)), pa.array(list(total))], ["table", "sums"])

    def sizes(batches):
        for batch in batches:
            code = batch.column(0).dictionary_encode()
            order = np.argsort(code.indices.to_numpy(zero_copy_only=False), kind="stable")
            first = np.searchsorted(code.indices.to_numpy(zero_copy_only=False)[order], np.arange(len(code.dictionary)))
            if len(order):
                count = np.add.reduceat(np.abs(of(batch.column(1)))[order], first, axis=0, dtype=np.int64)
                at, table = np.nonzero(count)
                yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(at)), pa.array(table.astype(np.int32)), pa.array(count[at, table])], ["row_label", "table", "size"])

    @F.arrow_udf(ArrayType(LongType()))
    def bits(column: pa.Array) -> pa.Array:
        """Bits of the tables that hold a row as it is, then of those that hold it spoilt."""
        w = of(column)
        packed = [np.packbits(np.pad(b, ((0, 0), (0, 64 * words - tables))), axis=1, bitorder="little") for b in (w > 0, w < 0)]
        return pa.array(list(np.concatenate(packed, axis=1).view("<i8")), pa.list_(pa.int64()))

    doubles = [F.col(f"{kind}_{i}").cast("double").alias(f"{kind}_{i}") for kind in ("clean", "spoilt") for i in range(d)]
    sums = rows.select(*doubles, "hash").mapInArrow(add, "table int, sums array<double>").groupBy("table").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(1 + 7 * d + 6 * len(pairs))]).where("s0 > 0")
    classes = rows.where("row_label is not null").select("row_label", "hash").mapInArrow(sizes, StructType([StructField("row_label", rows.schema["row_label"].dataType), StructField("table", IntegerType()), StructField("size", LongType())]))
    classes = classes.groupBy("table", "row_label").agg(F.sum("size").alias("size"))

    kinds = [F.struct("row_label", *[F.col(f"{kind}_{i}").alias(f"column_{i}") for i in range(d)], *[F.col("bits")[k * words + i].alias(f"bits_{i}") for i in range(words)]) for k, kind in enumerate(("clean", "spoilt"))]
    held = rows.withColumn("bits", bits("hash")).select(F.inline(F.array(*kinds))).where(" or ".join(f"bits_{i} <> 0" for i in range(words)))
    held = held.groupBy("row_label", *[f"column_{i}" for i in range(d)]).agg(*[F.bit_or(f"bits_{i}").alias(f"bits_{i}") for i in range(words)])
    ones = lambda i, k: F.sum(F.shiftrightunsigned(f"bits_{i}", k).bitwiseAND(F.lit(1).cast("long")))
    different = held.agg(F.array(*[ones(k // 64, k % 64) for k in range(tables)]).alias("counts")).select(F.posexplode("counts").alias("table", "different"))

    s = [F.col(f"s{i}") for i in range(1 + 7 * d + 6 * len(pairs))]
    none = lambda m, square: F.when(m > 1e-11 * square, m)
    skew, kurtosis, correlation = [], [], []
    for i in range(d):
        n, s1, s2, s3, s4 = s[1 + 7 * i + 2 : 1 + 7 * i + 7]
        e = ratio(s1, n)
        m2 = none(s2 - n * e * e, s2)
        skew.append(F.abs(_zero(ratio(F.sqrt(n) * (s3 - 3 * e * s2 + 2 * n * e * e * e), F.pow(m2, F.lit(1.5))))))
        kurtosis.append(F.abs(_zero(F.try_divide(n * (s4 - 4 * e * s3 + 6 * e * e * s2 - 3 * n * e * e * e * e), m2 * m2) - 3)))
    for k in range(len(pairs)):
        n, a, b, aa, bb, ab = s[1 + 7 * d + 6 * k : 1 + 7 * d + 6 * k + 6]
        correlation.append(F.abs(_zero(ratio(ab - ratio(a * b, n), F.sqrt(none(aa - ratio(a * a, n), aa) * none(bb - ratio(b * b, n), bb))))))
    main = sums.select(
        "table", s[0].cast("long").alias("n"), _mean([ratio(s[1 + 7 * i], s[0]) for i in range(d)]).alias("missing_rate"), _mean(skew).alias("mean_skew"), _mean(kurtosis).alias("mean_kurtosis"),
        (_mean(correlation) if pairs else F.lit(0.0)).alias("mean_correlation"), reduce(Column.__add__, [s[2 + 7 * i] for i in range(d)], F.lit(0.0)).cast("long").alias("outliers"),
    )
    return _numbers(main, different, classes)


@dataclass
class Predictor:
    """Boosted trees, and the quantile of held-out residuals that an interval is made of."""

    model: GBTRegressionModel
    width: float
    share: float
    error: float
    mean_error: float

    def predict(self, numbers: DataFrame) -> DataFrame:
        """table, predicted, low, high of rows of ``NUMBERS``, within 0 and 100."""
        x = VectorAssembler(inputCols=NUMBERS, outputCol="x").transform(numbers)
        out = self.model.transform(x)
        held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
        return out.select("table", held(F.col("prediction")).alias("predicted"), held(F.col("prediction") - self.width).alias("low"), held(F.col("prediction") + self.width).alias("high"))


def learn(numbers: DataFrame, share: float = 0.9, trees: int = 20, depth: int = 4, seed: int = 42) -> Predictor:
    """A predictor of ``quality`` from rows of ``NUMBERS``, one for each table.

    Three fifths of the tables, by hash, train; a fifth gives the residuals whose
    quantile, at ``share``, is half the interval; a fifth gives the errors told,
    of the predictor and of the training tables' mean.
    """
    part = numbers.withColumn("part", F.pmod(F.xxhash64("table", F.lit(seed)), F.lit(5)))
    x = VectorAssembler(inputCols=NUMBERS, outputCol="x").transform(part)
    train = x.where("part < 3")
    model = GBTRegressor(featuresCol="x", labelCol="quality", maxIter=trees, maxDepth=depth, seed=seed).fit(train)
    mean = train.agg(F.avg("quality")).first()[0]
    rest = model.transform(x.where("part >= 3")).select("part", F.abs(F.col("quality") - F.col("prediction")).alias("e"), F.abs(F.col("quality") - F.lit(mean)).alias("m")).collect()  # two fifths of the tables, a row each
    calibration = sorted(r["e"] for r in rest if r["part"] == 3)
    held = [r for r in rest if r["part"] == 4]
    at = min(len(calibration) - 1, math.ceil(share * (len(calibration) + 1)) - 1)
    average = lambda xs: sum(xs) / max(1, len(xs))
    return Predictor(model, calibration[at] if calibration else math.inf, share, average([r["e"] for r in held]), average([r["m"] for r in held]))


@dataclass
class Student:
    """A small tree that stands in for a costlier score, and how well it does on rows it has not seen."""

    model: DecisionTreeRegressionModel
    columns: list[str]
    correlation: float
    error: float
    agreement: float

    def score(self, df: DataFrame, key: str) -> DataFrame:
        """key, score of every row, in the JVM; nulls count as 0."""
        return self.model.transform(_assembled(df, self.columns)).select(key, F.col("prediction").alias("score"))


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    names = [f"student_{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=names, outputCol="student_x").transform(df.withColumns({n: zero_filled(c) for n, c in zip(names, columns, strict=True)}))


def distil(df: DataFrame, key: str, columns: list[str], teacher: DataFrame, flag_share: float = 0.1, depth: int = 6, held: float = 0.2, seed: int = 42) -> Student:
    """A tree learnt from a teacher's scores (key, score) of rows, on four fifths of them by hash.

    Told on the rest: the correlation with the teacher, the mean error, and the
    share of rows on which both agree whether they are among the ``flag_share``
    of the highest scores. Rows without a score are not learnt from.
    """
    rows = _assembled(df, columns).join(teacher.select(F.col(key).alias("teacher_key"), F.col("score").cast("double").alias("teacher_score")), F.col(key) == F.col("teacher_key")).where("teacher_score is not null")
    part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) / 1000 < held
    model = DecisionTreeRegressor(featuresCol="student_x", labelCol="teacher_score", maxDepth=depth, seed=seed).fit(rows.where(~part))
    told = model.transform(rows.where(part)).select("teacher_score", "prediction")
    cuts = quantiles(told, ["teacher_score", "prediction"], [1 - flag_share])
    flags = [F.col(c) > F.lit(cuts[c][0]) for c in ("teacher_score", "prediction")]
    one = told.agg(F.corr("teacher_score", "prediction").alias("c"), F.avg(F.abs(F.col("teacher_score") - F.col("prediction"))).alias("e"), F.avg((flags[0] == flags[1]).cast("double")).alias("a")).first()
    return Student(model, columns, one["c"] if one["c"] is not None else 0.0, one["e"] or 0.0, one["a"] or 0.0)
