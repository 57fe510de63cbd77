"""Column expressions that operators share: bands, hashes, vectors, masks, numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, but: list[str] | tuple = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def string_columns(df: DataFrame, but: list[str] | tuple = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in but]


def zero_filled(c: str) -> Column:
    """Null and NaN as 0, as detectors see numbers."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def bands(value: Column, steps: list[tuple[float, object]], otherwise: object, strict: bool = True) -> Column:
    """The first step whose bound lies above the value (or at it, if not ``strict``)."""
    out = None
    for bound, result in steps:
        test = value < bound if strict else value <= bound
        out = F.when(test, F.lit(result)) if out is None else out.when(test, F.lit(result))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def row_text(columns: list[str]) -> Column:
    """The row as text that tells all rows apart: each value after its length, nulls as a lone sign."""
    one = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-"))
    return F.concat_ws("|", *[one(F.col(c).cast("string")) for c in columns])


def row_hash(columns: list[str]) -> Column:
    return F.md5(row_text(columns))


def dot(a: Column, b: Column) -> Column:
    d = lambda x, y: x.cast("double") * y.cast("double")
    return F.aggregate(F.zip_with(a, b, d), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    d = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, d), F.lit(0.0), lambda s, x: s + x))


def add_all(columns: list[Column], start: Column | None = None) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0) if start is None else start)


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, ``otherwise`` where b is 0 or null."""
    return F.coalesce(a.cast("double") / F.when(b != 0, b.cast("double")), F.lit(otherwise))
