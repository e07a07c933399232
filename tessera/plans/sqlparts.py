"""SQL text fragments shared by oracle queries (DuckDB dialect, plain ANSI where possible)."""

from __future__ import annotations

from tessera.functions import rules as R


def nonneg(c: str) -> str:
    return f"greatest(coalesce(TRY_CAST({c} AS DOUBLE), 0.0), 0.0)"


def flag01(c: str) -> str:
    return f"least(greatest(coalesce(TRY_CAST({c} AS DOUBLE), 0.0), 0.0), 1.0)"


def raw_severity(prefix: str = "") -> str:
    p = prefix
    return (f"({R.W_KILL} * ln(1 + {nonneg(p + 'nkill')}) + {R.W_WOUND} * ln(1 + {nonneg(p + 'nwound')})"
            f" + {R.W_SUCCESS} * {flag01(p + 'success')} + {R.W_CLAIMED} * {flag01(p + 'claimed')})")


def normalise(raw: str, mn: str, mx: str) -> str:
    return (f"CASE WHEN ({mx}) = ({mn}) OR ({mx}) = 0 THEN 0.0 ELSE round_even(least(greatest("
            f"(({raw}) - ({mn})) / (({mx}) - ({mn})) * 100.0, 0.0), 100.0), 2) END")


def tsi_default(prefix: str = "") -> str:
    lo, hi = R.DEFAULT_BOUNDS
    return normalise(raw_severity(prefix), str(lo), str(hi))


def null_island_lat(prefix: str = "") -> str:
    p = prefix
    return (f"CASE WHEN coalesce(abs({p}latitude) < 0.01 AND abs({p}longitude) < 0.01, false) "
            f"THEN NULL ELSE {p}latitude END")


def null_island_lon(prefix: str = "") -> str:
    p = prefix
    return (f"CASE WHEN coalesce(abs({p}latitude) < 0.01 AND abs({p}longitude) < 0.01, false) "
            f"THEN NULL ELSE {p}longitude END")


# Incidents as the analytics read them: null island removed, casualties coerced, the
# default-bounds severity attached (the same as ``operators.prep.scored_incidents``).
SCORED_INCIDENTS_CTE = f"""scored AS (
  SELECT incident_id, iyear, imonth, iday, country_txt, region_txt, city, attacktype1_txt,
    weaptype1_txt, targtype1_txt, gname,
    {null_island_lat()} AS latitude, {null_island_lon()} AS longitude,
    {nonneg('nkill')} AS nkill, {nonneg('nwound')} AS nwound,
    CAST({flag01('success')} AS INT) AS success, CAST({flag01('suicide')} AS INT) AS suicide,
    CAST({flag01('claimed')} AS INT) AS claimed,
    {tsi_default()} AS tsi
  FROM incidents)"""
