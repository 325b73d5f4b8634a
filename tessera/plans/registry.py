"""Registry of named queries: a Spark builder plus (optionally) its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FAMILY: dict[str, str] = {}

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def query(name: str, sql: str | None = None, family: str = ""):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        FAMILY[name] = family or fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all():
    """Import every plan module so that its queries register."""
    from . import (  # noqa: F401
        q_quality, q_clean, q_features, q_encode, q_eval, q_charts, q_monitor, q_recipes,
        q_timeseries, q_anomaly, q_text, q_graph, q_ml, q_sources, q_streaming, q_more, q_density, q_forecast, q_learned, q_retrain, q_deliveries,
    )
    return QUERIES, ORACLE
