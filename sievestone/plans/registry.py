"""Plug-ins by kind and name, and where they take part.

- detector (table, key, numeric columns): one more issue table of ``analyze``
- loader (session, path, schema) and exporter (table, path, mode): formats of ``read_any`` and ``write_any``
- fixer, operation (table, **options): steps of ``operated``
- metric (table): an aggregate of ``measured``; evaluator (table): a column of ``evaluated``
- rule (row of scores as a dict): a text, or nothing, of ``Analysis.recommendations``
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

KINDS = ("detector", "loader", "exporter", "fixer", "metric", "evaluator", "operation", "rule")
_PLUGINS: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Decorator: make a DataFrame function known under a name."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; kinds are {KINDS}")

    def keep(f: Callable) -> Callable:
        _PLUGINS[kind][name] = f
        return f

    return keep


def get(kind: str, name: str) -> Callable:
    return _PLUGINS[kind][name]


def names(kind: str) -> list[str]:
    return sorted(_PLUGINS[kind])


def forget(kind: str, name: str) -> None:
    _PLUGINS[kind].pop(name, None)


def measured(df: DataFrame, *metrics: str) -> DataFrame:
    """One row: the metrics named, or all, each an aggregate column, in one pass."""
    return df.agg(*[get("metric", m)(df).alias(m) for m in metrics or names("metric")])


def evaluated(df: DataFrame, weights: dict[str, float] | None = None, overall: str = "overall") -> DataFrame:
    """The table with a column for each evaluator named by ``weights``, or all alike, and their weighted mean; null scores are left out of a row's mean."""
    from functools import reduce

    from pyspark.sql import Column
    from pyspark.sql import functions as F

    weights = weights or dict.fromkeys(names("evaluator"), 1.0)
    out = df.withColumns({k: get("evaluator", k)(df) for k in weights})
    total = reduce(Column.__add__, [F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()])
    known = reduce(Column.__add__, [F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()])
    return out.withColumn(overall, total / F.when(known > 0, known))


def operated(df: DataFrame, *steps: tuple[str, dict]) -> DataFrame:
    """The table after operations, or fixers, by name with their options, one after the other."""
    for name, options in steps:
        df = (_PLUGINS["operation"].get(name) or get("fixer", name))(df, **options)
    return df


#: Settings of detectors for precision, recall or speed.
PRESETS = {
    "high_precision": {"z_threshold": 4.0, "iqr_multiplier": 3.0, "similarity": 0.98, "label_confidence": 0.9},
    "high_recall": {"z_threshold": 2.0, "iqr_multiplier": 1.0, "similarity": 0.8, "label_confidence": 0.3},
    "fast_scan": {"z_threshold": 3.0, "iqr_multiplier": 1.5, "similarity": 1.0, "label_confidence": 0.5},
}


def detectors(preset: str) -> dict[str, Callable]:
    """Outlier and vector-duplicate detectors by name, each with the settings of a preset: functions of (table, key, columns or vector)."""
    from ..operators import outliers, vectors

    s = PRESETS[preset]
    return {
        "zscore": lambda df, key, columns: outliers.zscore(df, key, columns, s["z_threshold"]),
        "iqr": lambda df, key, columns: outliers.iqr(df, key, columns, s["iqr_multiplier"]),
        "duplicates": lambda df, key, vector: vectors.near_pairs(df, key, vector, s["similarity"]),
    }
