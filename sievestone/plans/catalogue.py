"""Every query of the engine by name, with SQL for checking it.

Doubles named in ``rounded`` are rounded to six places in both engines, since
sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, rounded: str = "") -> Callable[[Query], Query]:
    doubles = rounded.split()

    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in doubles}) if doubles else df

        _QUERIES[name] = run
        if sql:
            _SQL[name] = f"select * replace ({', '.join(f'round({c}::double, 6) as {c}' for c in doubles)}) from ({sql})" if doubles else sql
        return run

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries_core import document_scores

    return document_scores(spark, sf_dir)


def _load() -> None:
    from . import queries_core, queries_depth, queries_facade, queries_more, queries_stats, queries_text  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
