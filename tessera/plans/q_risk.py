"""Country risk, reports, recommendations, alerts, weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions.expr import normalize_country_sql, round_even
from tessera.operators import risk
from tessera.operators.prep import scored_incidents
from tessera.plans.q_live import LIVE_CTES, POINTS_SQL, live_feed
from tessera.plans.registry import query

PERIOD = (1999, 2001)  # F13 / R9 / R12 window; previous = 1996-1998
W = R.RISK_WEIGHTS
_LEVEL_SQL = "CASE level " + " ".join(f"WHEN '{lv}' THEN '{t}'" for lv, t in R.LEVEL_RECOMMENDATION) + " END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RISK_CTES = f"""{LIVE_CTES},
pc AS (SELECT country_txt, count(*) AS n_country, avg(nkill) AS mean_kill FROM scored
  WHERE country_txt IS NOT NULL GROUP BY country_txt),
nall AS (SELECT count(*) AS n_all FROM scored),
pk0 AS (SELECT country_txt, round_even(latitude * 10, 0) AS a, round_even(longitude * 10, 0) AS b, count(*) AS n
  FROM scored WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2, 3),
pk AS (SELECT country_txt, max(n) AS peak FROM pk0 GROUP BY country_txt),
lv AS (SELECT {normalize_country_sql('country')} AS ckey, count(*) AS live_n, avg({POINTS_SQL}) AS live_points
  FROM livefeed GROUP BY 1),
comp AS (SELECT pc.country_txt, coalesce(lv.live_n, 0) AS live_n,
  least(pc.n_country / greatest(nall.n_all * CAST({R.RISK_ACTIVITY_SHARE} AS DOUBLE), 1.0), 1.0) * 100 AS activity_raw,
  least(coalesce(lv.live_n, 0) / CAST({R.RISK_RECENT_CAP} AS DOUBLE), 1.0) * 100 AS recent_raw,
  least(pc.mean_kill / CAST({R.RISK_FATALITY_CAP} AS DOUBLE), 1.0) * 100 AS fatal_raw,
  least(coalesce(pk.peak, 0) / CAST({R.RISK_DENSITY_CAP} AS DOUBLE), 1.0) * 100 AS density_raw,
  CASE WHEN lv.live_n > 0 THEN least(lv.live_points, 100.0) ELSE 0.0 END AS instab_raw
  FROM pc CROSS JOIN nall LEFT JOIN pk USING (country_txt)
  LEFT JOIN lv ON lv.ckey = {normalize_country_sql('pc.country_txt')}),
wc AS (SELECT country_txt, live_n, activity_raw,
  activity_raw * CAST({W['activity']} AS DOUBLE) AS c_activity, recent_raw * CAST({W['recent']} AS DOUBLE) AS c_recent,
  fatal_raw * CAST({W['fatalities']} AS DOUBLE) AS c_fatalities, density_raw * CAST({W['density']} AS DOUBLE) AS c_density,
  instab_raw * CAST({W['instability']} AS DOUBLE) AS c_instability FROM comp),
rk AS (SELECT *, CAST(round_even(c_activity + c_recent + c_fatalities + c_density + c_instability, 0) AS INT) AS score
  FROM wc),
rl AS (SELECT *, CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 55 THEN 'High' WHEN score >= 30 THEN 'Medium'
  ELSE 'Low' END AS level FROM rk),
chg AS (SELECT country_txt, sum(CASE WHEN iyear BETWEEN {PERIOD[0]} AND {PERIOD[1]} THEN 1 ELSE 0 END) AS cur,
  sum(CASE WHEN iyear BETWEEN {2 * PERIOD[0] - PERIOD[1] - 1} AND {PERIOD[0] - 1} THEN 1 ELSE 0 END) AS prev
  FROM scored GROUP BY country_txt),
chg2 AS (SELECT country_txt, CAST(cur AS BIGINT) AS current, CAST(prev AS BIGINT) AS previous,
  CASE WHEN prev > 0 THEN (cur - prev) / prev * 100 END AS activity_delta_pct FROM chg)"""

_R = lambda c: f"round_even({c}, 6) AS {c}"
RISK_COLS_SQL = ", ".join(["country_txt", "live_n", "score", "level"] + [
    _R(c) for c in ["c_activity", "c_recent", "c_fatalities", "c_density", "c_instability", "activity_raw"]])


def _risk(spark):
    hist = scored_incidents(spark)
    return hist, risk.country_risk(hist, live_feed(spark))


@query("r6_country_risk", bench=True, oracle=f"WITH {RISK_CTES}\nSELECT {RISK_COLS_SQL} FROM rl")
def r6_country_risk(spark):
    return risk.round_components(_risk(spark)[1])


for _name, _col in [("r1_historical_activity", "c_activity"), ("r2_recent_events", "c_recent"),
                    ("r3_fatality_component", "c_fatalities"), ("r4_cluster_density", "c_density"),
                    ("r5_instability", "c_instability")]:
    def _mk(col):
        def build(spark):
            return risk.round_components(_risk(spark)[1]).select("country_txt", col)
        return build
    query(_name, oracle=f"WITH {RISK_CTES}\nSELECT country_txt, round_even({_col}, 6) AS {_col} FROM rl")(_mk(_col))


@query("r7_risk_level", oracle=f"WITH {RISK_CTES}\nSELECT country_txt, score, level FROM rl")
def r7_risk_level(spark):
    return _risk(spark)[1].select("country_txt", "score", "level")


@query("r8_ranked_scores", oracle=f"""WITH {RISK_CTES}
SELECT country_txt, score, level, row_number() OVER (ORDER BY score DESC, country_txt) AS risk_rank FROM rl""")
def r8_ranked_scores(spark):
    r = _risk(spark)[1].select("country_txt", "score", "level")
    from pyspark.sql import Window
    return r.withColumn("risk_rank", F.row_number().over(Window.orderBy(F.desc("score"), "country_txt")))


@query("f13_activity_change", oracle=f"""WITH {RISK_CTES}
SELECT country_txt, current, previous, round_even(activity_delta_pct, 6) AS activity_delta_pct FROM chg2""")
def f13_activity_change(spark):
    c = risk.activity_change(scored_incidents(spark), *PERIOD)
    return c.withColumn("activity_delta_pct", round_even("activity_delta_pct", 6))


FACTS_CTES = f"""{RISK_CTES},
base AS (SELECT country_txt, count(*) AS historical_incidents, sum(nkill) AS historical_fatalities
  FROM scored GROUP BY country_txt),
area AS (SELECT country_txt, city AS top_area FROM (SELECT country_txt, city, row_number() OVER
  (PARTITION BY country_txt ORDER BY count(*) DESC, city) AS rn FROM scored WHERE city IS NOT NULL
  GROUP BY country_txt, city) t WHERE rn = 1),
ev AS (SELECT country, event, count(*) AS n FROM livefeed GROUP BY country, event),
evr AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, event) AS r FROM ev),
mix AS (SELECT country AS country_txt, string_agg(event, ', ' ORDER BY r) AS event_mix FROM evr WHERE r <= 3
  GROUP BY country),
facts AS (SELECT b.country_txt, b.historical_incidents, b.historical_fatalities, c.activity_delta_pct, a.top_area,
  rl.score, rl.level, rl.live_n, rl.c_activity, rl.c_recent, rl.c_fatalities, rl.c_density, rl.c_instability,
  coalesce(m.event_mix, '{risk.NO_LIVE}') AS event_mix
  FROM base b LEFT JOIN chg2 c USING (country_txt) LEFT JOIN area a USING (country_txt)
  LEFT JOIN rl USING (country_txt) LEFT JOIN mix m USING (country_txt))"""


def _facts(spark):
    return risk.report_facts(scored_incidents(spark), live_feed(spark), *PERIOD)


@query("r9_report_facts", oracle=f"""WITH {FACTS_CTES}
SELECT country_txt, historical_incidents, round_even(historical_fatalities, 6) AS historical_fatalities,
  round_even(activity_delta_pct, 6) AS activity_delta_pct, top_area, score, level, live_n, event_mix FROM facts""")
def r9_report_facts(spark):
    f = _facts(spark)
    return f.select("country_txt", "historical_incidents",
                    round_even("historical_fatalities", 6).alias("historical_fatalities"),
                    round_even("activity_delta_pct", 6).alias("activity_delta_pct"), "top_area", "score",
                    "level", "live_n", "event_mix")


_LINES_SQL = "printf(" + _q("\n".join(risk.REPORT_LINES)) + ", "


@query("r10_report_text", oracle=f"""WITH {FACTS_CTES}
SELECT country_txt, {_LINES_SQL} country_txt, '{PERIOD[0]}-{PERIOD[1]}', upper(level), score, historical_incidents,
  CAST(historical_fatalities AS BIGINT), CASE WHEN activity_delta_pct IS NULL
    THEN 'No earlier period of equal length to compare with.'
    ELSE printf('Against the period of equal length before: %+.1f%%.', round_even(activity_delta_pct, 1)) END,
  coalesce(top_area, '{risk.NO_AREA}'), coalesce(live_n, 0), event_mix, {', '.join(f'round_even({c}, 1)' for c in
  ('c_activity', 'c_recent', 'c_fatalities', 'c_density', 'c_instability'))}, {_LEVEL_SQL}) AS report FROM facts""")
def r10_report_text(spark):
    return risk.report_text(_facts(spark), f"{PERIOD[0]}-{PERIOD[1]}")


@query("l17_grounding_context", oracle=f"""WITH {FACTS_CTES}
SELECT country_txt, concat_ws(chr(10), '=== GTD Historical Statistics ===',
  '- incidents: ' || historical_incidents, '- top_area: ' || coalesce(top_area, 'None'),
  '=== Current Risk Assessment ===', '- score: ' || score, '- level: ' || level,
  '=== Live Intelligence Summary ===', '- live events: ' || live_n || ' (' || event_mix || ')') AS context
FROM facts""")
def l17_grounding_context(spark):
    f = _facts(spark)
    ctx = F.concat_ws(
        "\n", F.lit("=== GTD Historical Statistics ==="),
        F.concat(F.lit("- incidents: "), F.col("historical_incidents").cast("string")),
        F.concat(F.lit("- top_area: "), F.coalesce("top_area", F.lit("None"))),
        F.lit("=== Current Risk Assessment ==="),
        F.concat(F.lit("- score: "), F.col("score").cast("string")),
        F.concat(F.lit("- level: "), F.col("level")),
        F.lit("=== Live Intelligence Summary ==="),
        F.concat(F.lit("- live events: "), F.col("live_n").cast("string"), F.lit(" ("), F.col("event_mix"),
                 F.lit(")")))
    return f.select("country_txt", ctx.alias("context"))


@query("r11_level_recommendation", oracle=f"""WITH {RISK_CTES}
SELECT country_txt, level, {_LEVEL_SQL} AS recommendation FROM rl""")
def r11_level_recommendation(spark):
    r = _risk(spark)[1]
    return r.select("country_txt", "level", risk.level_recommendation(F.col("level")).alias("recommendation"))


def _rec_sql() -> str:
    bands = " UNION ALL ".join(
        f"SELECT {lo} AS band_lo, {order} AS seq, {_q(cat)} AS category, {_q(act)} AS action, "
        f"{_q(pri)} AS priority, {_q(why)} AS rationale" for lo, _hi, order, cat, act, pri, why in R.SCORE_BAND_RULES)
    attacks = " UNION ALL ".join(
        f"SELECT {o} AS attack_rule, {_q(c)} AS category, {_q(a)} AS action, {_q(why)} AS rationale"
        for o, _t, c, a, why in R.ATTACK_RULES)
    rule = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(dominant_attack), '{t}')" for t in terms) + f" THEN {o}"
        for o, terms, *_ in R.ATTACK_RULES) + " END"
    up, down, surge = R.TREND_UP, R.TREND_DOWN, R.SURGE
    return f"""WITH {RISK_CTES},
dom AS (SELECT country_txt, attacktype1_txt AS dominant_attack FROM (SELECT country_txt, attacktype1_txt,
  row_number() OVER (PARTITION BY country_txt ORDER BY count(*) DESC, attacktype1_txt) AS rn FROM scored
  WHERE attacktype1_txt IS NOT NULL GROUP BY 1, 2) t WHERE rn = 1),
inp AS (SELECT rl.country_txt, rl.score, rl.live_n, dom.dominant_attack,
  CASE WHEN c.activity_delta_pct > 0 THEN 'increasing' WHEN c.activity_delta_pct < 0 THEN 'decreasing'
    WHEN c.activity_delta_pct = 0 THEN 'stable' END AS trend,
  CASE WHEN rl.score >= 75 THEN 75 WHEN rl.score >= 55 THEN 55 WHEN rl.score >= 30 THEN 30 ELSE -1 END AS band_lo
  FROM rl LEFT JOIN dom USING (country_txt) LEFT JOIN chg2 c USING (country_txt)),
bands AS ({bands}),
attacks AS ({attacks}),
hi AS (SELECT *, CASE WHEN score >= 55 THEN 'High' ELSE 'Elevated' END AS hp, {rule} AS attack_rule FROM inp)
SELECT i.country_txt, b.seq, b.category, b.action, b.priority, replace(b.rationale, '{{score}}', CAST(i.score AS VARCHAR)) AS rationale
  FROM inp i JOIN bands b USING (band_lo)
UNION ALL SELECT h.country_txt, 10, a.category, a.action, h.hp, replace(a.rationale, '{{attack}}', h.dominant_attack)
  FROM hi h JOIN attacks a USING (attack_rule)
UNION ALL SELECT country_txt, 20, '{up[0]}', '{up[1]}', hp, '{up[2]}' FROM hi WHERE trend = 'increasing'
UNION ALL SELECT country_txt, 20, '{down[0]}', '{down[1]}', '{down[2]}', '{down[3]}' FROM hi
  WHERE trend = 'decreasing' AND score < 55
UNION ALL SELECT country_txt, 30, '{surge[0]}', '{surge[1]}', CASE WHEN score >= 75 THEN 'Critical' ELSE 'High' END,
  replace('{surge[2]}', '{{n}}', CAST(live_n AS VARCHAR)) FROM hi WHERE live_n >= {R.SURGE_MIN_EVENTS}"""


@query("r12_recommendations", oracle=_rec_sql())
def r12_recommendations(spark):
    inp = risk.recommendation_inputs(scored_incidents(spark), live_feed(spark), *PERIOD)
    return risk.recommendations(inp)


@query("r13_threshold_alerts", oracle=f"""WITH {RISK_CTES}
SELECT country_txt, score, level, round_even(activity_raw, 6) AS activity_raw FROM rl
WHERE score >= 60 AND activity_raw >= 50""")
def r13_threshold_alerts(spark):
    r = risk.threshold_alerts(_risk(spark)[1])
    return r.select("country_txt", "score", "level", round_even("activity_raw", 6).alias("activity_raw"))


_T = R.WEATHER_RULES
WEATHER_CTES = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country
  ORDER BY observed_at DESC, obs_id DESC) AS rn FROM weather_obs) t WHERE rn = 1),
imp AS (
  SELECT country, obs_id, 1 AS seq, 'Visibility' AS factor, CASE WHEN visibility_km < {_T['visibility_critical']}
    THEN 'Critical' WHEN visibility_km < {_T['visibility_degraded']} THEN 'Degraded' ELSE 'Good' END AS status,
    visibility_km AS value FROM latest
  UNION ALL SELECT country, obs_id, 2, 'Wind', CASE WHEN wind_speed_ms > {_T['wind_critical']} THEN 'Critical'
    WHEN wind_speed_ms > {_T['wind_degraded']} THEN 'Degraded' ELSE 'Good' END, wind_speed_ms FROM latest
  UNION ALL SELECT country, obs_id, 3, 'Precipitation', CASE WHEN rain_mm > {_T['rain_critical']} THEN 'Critical'
    WHEN rain_mm > {_T['rain_degraded']} THEN 'Degraded' ELSE 'Good' END, rain_mm FROM latest
  UNION ALL SELECT country, obs_id, 4, 'Temperature', CASE WHEN temperature_c > {_T['heat_critical']}
    OR temperature_c < {_T['cold_critical']} THEN 'Critical' ELSE 'Good' END, temperature_c FROM latest)"""


@query("r14_weather_impact", oracle=f"WITH {WEATHER_CTES}\nSELECT * FROM imp")
def r14_weather_impact(spark):
    return risk.weather_impact(spark.table("weather_obs"))


@query("r14_worst_weather", oracle=f"""WITH {WEATHER_CTES}
SELECT country, CASE max(CASE status WHEN 'Critical' THEN 2 WHEN 'Degraded' THEN 1 ELSE 0 END)
  WHEN 2 THEN 'Critical' WHEN 1 THEN 'Degraded' ELSE 'Good' END AS worst_status FROM imp GROUP BY country""")
def r14_worst_weather(spark):
    return risk.worst_weather(risk.weather_impact(spark.table("weather_obs")))
