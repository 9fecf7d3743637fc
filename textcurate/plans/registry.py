"""Query registry: each registered query is a Spark plan over the driver tables
plus (when SQL can express it) an independent DuckDB SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def normalise(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Output contract shared with the SQL oracle: integers as long, fractional
    numbers as double rounded to ``decimals`` (so summation order cannot change
    a value hash)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), decimals)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import every catalogue module (each registers its queries)."""
    import importlib

    for mod in CATALOGUES:
        importlib.import_module(f"textcurate.plans.{mod}")


CATALOGUES = ["catalog_curate", "catalog_text", "catalog_dedup", "catalog_splits", "catalog_leakage", "catalog_profile",
              "catalog_metrics", "catalog_leaderboard", "catalog_augment", "catalog_io",
              "catalog_models", "catalog_stream"]
