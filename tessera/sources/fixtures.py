"""Temp views over the driver tables and the matching DuckDB CTE prefix."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.fixture_sql import FIXTURE_SQL

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")
FIXTURE_VIEWS = tuple(FIXTURE_SQL)

_registered: dict[int, str] = {}


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    """Register the raw parquet tables and the fixture views for ``sf_dir``.

    Views are lazy: nothing is read until a query runs, and every query reads only
    the columns it needs (Catalyst prunes through the views to the parquet scan).
    """
    key = id(spark)
    # event times are UTC wall-clock values (as in the reference): pin the zone
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if _registered.get(key) == sf_dir and spark.catalog.tableExists("incidents"):
        return
    for name in RAW_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, sql in FIXTURE_SQL.items():
        spark.sql(sql).createOrReplaceTempView(name)
    _registered[key] = sf_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_tables(spark, sf_dir)
    return spark.table(name)


def with_fixtures(body: str) -> str:
    """Prefix an oracle query with the fixture CTEs (merging its own WITH clause)."""
    ctes = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in FIXTURE_SQL.items())
    stripped = body.lstrip()
    m = re.match(r"(?is)with\s+recursive\s+", stripped)
    if m:
        return f"WITH RECURSIVE {ctes},\n{stripped[m.end():]}"
    m = re.match(r"(?is)with\s+", stripped)
    if m:
        return f"WITH {ctes},\n{stripped[m.end():]}"
    return f"WITH {ctes}\n{stripped}"
