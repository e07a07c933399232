"""Named queries: a Spark builder and, where SQL can express it, a DuckDB oracle.

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame.  Oracle bodies are
written against the fixture names (incidents, live_articles, assets, weather_obs,
messages) and the raw tables; ``with_fixtures`` adds the projection CTEs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.fixtures import register_tables, with_fixtures


@dataclass(frozen=True)
class NamedQuery:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    bench: bool = False


REGISTRY: dict[str, NamedQuery] = {}


def query(name: str, oracle: str | None = None, bench: bool = False):
    """Register ``fn(spark) -> DataFrame``; views for ``sf_dir`` are set up first."""
    def deco(fn: Callable[[SparkSession], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            register_tables(spark, sf_dir)
            return fn(spark)
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = NamedQuery(name, build, oracle, bench)
        return fn
    return deco


def load_all() -> dict[str, NamedQuery]:
    # Importing the modules registers their queries.
    import importlib
    for mod in PLAN_MODULES:
        importlib.import_module(f"tessera.plans.{mod}")
    return REGISTRY


PLAN_MODULES = ["q_sources", "q_clean", "q_scoring", "q_spatial", "q_series", "q_forecast",
                "q_live", "q_risk", "q_network", "q_similarity", "q_learning", "q_streams",
                "q_conformance"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v.build for k, v in load_all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: with_fixtures(v.oracle) for k, v in load_all().items() if v.oracle}
