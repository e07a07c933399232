"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: str | Column, digits: int) -> Column:
    """numpy-style round half to even (``bround`` on doubles differs: SURVEY 4.4)."""
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km; the asin argument is clamped to 1."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dlat = p2 - p1
    dlon = F.radians(col(lon2)) - F.radians(col(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The same distance as SQL text (runs in Spark and DuckDB)."""
    return (f"2 * {EARTH_RADIUS_KM} * asin(sqrt(least(1.0, "
            f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * "
            f"pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))")


def unit_xyz(lat: str | Column, lon: str | Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere (no trouble at the poles or the antimeridian)."""
    p, l = F.radians(col(lat)), F.radians(col(lon))
    return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)


def chord_for_km(eps_km: float) -> float:
    return 2.0 * math.sin(eps_km / (2.0 * EARTH_RADIUS_KM))


def nonneg(c: str | Column) -> Column:
    """Bad/NULL -> 0, then clip at 0 (casualty coercion)."""
    return F.greatest(F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str)
                                 else c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def flag01(c: str | Column) -> Column:
    """Bad/NULL -> 0, then clip to [0, 1] (success / suicide / claimed)."""
    v = F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return F.least(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def ordered_rules(target: Column, rules: Sequence[tuple[str, Sequence[str]]],
                  default: str) -> Column:
    """First label whose any term is a substring of ``target`` (rule order = priority)."""
    expr = None
    for label, terms in rules:
        cond = None
        for term in terms:
            c = target.contains(term)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)


def ordered_rules_sql(target: str, rules: Sequence[tuple[str, Sequence[str]]],
                      default: str) -> str:
    """The same rule chain as SQL text (``contains`` exists in Spark and DuckDB)."""
    parts = []
    for label, terms in rules:
        cond = " OR ".join(f"contains({target}, '{t}')" for t in terms)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + f" ELSE '{default}' END"


def normalize_country(c: str | Column) -> Column:
    """Lower first, then non-alphanumerics -> one space, trim (quirk 3 fixed)."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


def normalize_country_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def source_id(title: str | Column) -> Column:
    """First 40 hex of SHA-256 of the trimmed, lower-cased title."""
    return F.substring(F.sha2(F.lower(F.trim(col(title))), 256), 1, 40)
