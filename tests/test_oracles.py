"""Named queries against their DuckDB oracle at sf0.001 (the driver runs all at sf0.01).

Every query with an oracle runs (some ten minutes); TESSERA_FAST_ORACLES=1 runs one of each kind.
"""

import math
import os

import duckdb
import pytest

from tessera.plans.registry import load_all
from tessera.sources.fixtures import RAW_TABLES, with_fixtures

REG = load_all()
# One of each kind, for quick runs.
FAST = ["s1_csv_scan", "s1_csv_problems", "s3_typed_projection", "s7_prepared_csv_sink", "s8_article_json", "s10_store_tables",
        "c8_prepare_chronological", "c9_class_distribution", "t2_severity_stored_bounds", "t3_severity_self_normalised",
        "f4_arima_order_selection", "f11_country_year_totals", "f12_timeline_yoy", "g8_peak_cell", "g9_country_centroids",
        "g10_radius_summary", "l8_centroid_enrichment", "l12_live_rows", "r6_country_risk", "r9_report_facts", "r10_report_text",
        "r12_recommendations", "n2_group_profiles", "n6_region_network", "q3_vocabulary", "q5_similar_incidents",
        "m1_chronological_split", "m4_ordinal_encoding", "m8_rule_predictor_metrics", "m10_rule_cross_validation",
        "st2_lookback_counts", "st4_stream_surge", "x1_inner_join", "x2_asof_join", "x4_windows", "x5_set_operations"]
NAMES = FAST if os.environ.get("TESSERA_FAST_ORACLES") else [n for n, q in REG.items() if q.oracle]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, small, duck, name):
    q = REG[name]
    df = q.build(spark, small)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(with_fixtures(q.oracle))
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == _rows(cols, res.fetchall())
