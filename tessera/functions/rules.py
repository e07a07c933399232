"""Rule and lookup tables.

Fixed values: the labels, terms, weights, cut-offs and mappings below must equal the
reference's for equal results.  They are stated plainly, in the reference's order,
because order is priority for the keyword rules.
"""

from __future__ import annotations

# ---- Fixed values: severity index weights and defaults -------------------------------
W_KILL, W_WOUND, W_SUCCESS, W_CLAIMED = 0.50, 0.30, 0.15, 0.05
DEFAULT_BOUNDS = (0.0, 5.0)
SEVERITY_LABELS = [(75.0, "CRITICAL"), (50.0, "HIGH"), (25.0, "MEDIUM")]  # else LOW
POWER_LAW = dict(kill_weight=3.0, wound_weight=1.0, exponent=0.85,
                 success_multiplier=1.0, fail_multiplier=0.4)

# ---- Fixed values: live feed keyword rules (ordered) ---------------------------------
EVENT_RULES = [
    ("Missile / Rocket", ("missile", "rocket", "drone strike", "airstrike")),
    ("Explosion / Bombing", ("explosion", "blast", "bomb", "ied", "suicide")),
    ("Border Clash", ("border", "clash", "cross-border", "shelling")),
    ("Armed Conflict", ("military", "armed", "combat", "offensive", "conflict")),
    ("Terror Incident", ("terror", "terrorism", "militant", "insurgent", "attack")),
]
EVENT_DEFAULT = "Security Event"

SEVERITY_RULES = [
    ("Critical", ("massacre", "deadliest", "mass casualty", "dozens killed", "missile")),
    ("High", ("killed", "dead", "fatal", "explosion", "bombing", "airstrike")),
    ("Medium", ("wounded", "injured", "clash", "shelling", "attack")),
]
SEVERITY_DEFAULT = "Low"
SEVERITY_POINTS = {"Low": 20, "Medium": 45, "High": 70, "Critical": 90}

# ---- Fixed values: chat intent rules (ordered) ---------------------------------------
INTENT_RULES = [
    ("highest_risk", ("highest risk", "most dangerous", "riskiest")),
    ("compare", ("compare", "versus", "vs")),
    ("live", ("today", "latest", "recent", "live")),
    ("forecast", ("forecast", "predict", "future")),
    ("hotspot", ("hotspot", "cluster", "concentration")),
    ("help", ("help", "what can you", "capabilities")),
]
INTENT_DEFAULT = "general"

# ---- Fixed values: live row -> incident schema lookups -------------------------------
EVENT_TO_ATTACK = [
    ("Missile / Rocket", "Bombing/Explosion"),
    ("Explosion / Bombing", "Bombing/Explosion"),
    ("Border Clash", "Armed Assault"),
    ("Armed Conflict", "Armed Assault"),
    ("Terror Incident", "Unknown"),
    ("Hostage / Kidnap", "Hostage Taking (Kidnapping)"),
    ("Assassination", "Assassination"),
    ("Cyberattack", "Facility/Infrastructure Attack"),
    ("Unknown", "Unknown"),
]
COUNTRY_TO_REGION = [
    ("Iraq", "Middle East & North Africa"), ("Syria", "Middle East & North Africa"),
    ("Israel", "Middle East & North Africa"), ("Lebanon", "Middle East & North Africa"),
    ("Yemen", "Middle East & North Africa"), ("Libya", "Middle East & North Africa"),
    ("Egypt", "Middle East & North Africa"), ("Jordan", "Middle East & North Africa"),
    ("Saudi Arabia", "Middle East & North Africa"), ("Iran", "Middle East & North Africa"),
    ("Turkey", "Middle East & North Africa"),
    ("India", "South Asia"), ("Pakistan", "South Asia"), ("Afghanistan", "South Asia"),
    ("Bangladesh", "South Asia"), ("Sri Lanka", "South Asia"), ("Nepal", "South Asia"),
    ("Nigeria", "Sub-Saharan Africa"), ("Somalia", "Sub-Saharan Africa"),
    ("Mali", "Sub-Saharan Africa"), ("Niger", "Sub-Saharan Africa"),
    ("Sudan", "Sub-Saharan Africa"), ("South Sudan", "Sub-Saharan Africa"),
    ("Ethiopia", "Sub-Saharan Africa"), ("Kenya", "Sub-Saharan Africa"),
    ("Mozambique", "Sub-Saharan Africa"),
    ("Democratic Republic of the Congo", "Sub-Saharan Africa"),
    ("Cameroon", "Sub-Saharan Africa"), ("Burkina Faso", "Sub-Saharan Africa"),
    ("Chad", "Sub-Saharan Africa"),
    ("Ukraine", "Eastern Europe"), ("Russia", "Eastern Europe"), ("Georgia", "Eastern Europe"),
    ("France", "Western Europe"), ("Germany", "Western Europe"), ("Spain", "Western Europe"),
    ("United Kingdom", "Western Europe"), ("Italy", "Western Europe"),
    ("Belgium", "Western Europe"),
    ("United States", "North America"), ("Mexico", "North America"),
    ("Canada", "North America"),
    ("Colombia", "South America"), ("Brazil", "South America"),
    ("Venezuela", "South America"), ("Peru", "South America"),
    ("Philippines", "Southeast Asia"), ("Myanmar", "Southeast Asia"),
    ("Indonesia", "Southeast Asia"), ("Thailand", "Southeast Asia"),
    ("Kazakhstan", "Central Asia"), ("Kyrgyzstan", "Central Asia"),
]
ATTACK_TO_WEAPON = [
    ("Bombing/Explosion", "Explosives"),
    ("Armed Assault", "Firearms"),
    ("Assassination", "Firearms"),
    ("Hostage Taking (Kidnapping)", "Unknown"),
    ("Facility/Infrastructure Attack", "Unknown"),
    ("Unknown", "Unknown"),
]
SEVERITY_TO_NKILL = [("Critical", 5), ("High", 2), ("Medium", 0), ("Low", 0)]
SEVERITY_TO_NWOUND = [("Critical", 10), ("High", 5), ("Medium", 2), ("Low", 0)]

# ---- Fixed values: historical fallback feed ------------------------------------------
FALLBACK_SOURCE = "GTD Historical Archive"
FALLBACK_URL = "https://start.umd.edu/gtd"
FALLBACK_TITLE = "Historical Event: %s in %s"

# ---- Fixed values: cleaning ----------------------------------------------------------
REQUIRED_COLS = ["iyear", "imonth", "iday", "latitude", "longitude", "country_txt",
                 "region_txt", "city", "attacktype1_txt", "weaptype1_txt",
                 "targtype1_txt", "gname", "success", "suicide", "nkill", "nwound"]
COL_ALIASES = [("country", "country_txt"), ("region", "region_txt"),
               ("attack_type", "attacktype1_txt"), ("weapon_type", "weaptype1_txt"),
               ("target_type", "targtype1_txt"), ("group", "gname"),
               ("killed", "nkill"), ("wounded", "nwound")]
UNKNOWN_LABELS = ["", "nan", "Unknown", "unknown"]
NULL_TEXT = ["nan", "", "NaN"]
TEXT_COLS = ["country_txt", "region_txt", "attacktype1_txt", "weaptype1_txt",
             "targtype1_txt", "gname", "city"]
BARRICADE = "Hostage Taking (Barricade Incident)"
KIDNAPPING = "Hostage Taking (Kidnapping)"

# ---- Fixed values: country risk ------------------------------------------------------
RISK_WEIGHTS = dict(activity=0.35, recent=0.25, fatalities=0.15, density=0.10,
                    instability=0.15)
RISK_ACTIVITY_SHARE = 0.08
RISK_RECENT_CAP = 10.0
RISK_FATALITY_CAP = 8.0
RISK_DENSITY_CAP = 250.0
RISK_LEVELS = [(75, "Critical"), (55, "High"), (30, "Medium")]  # else Low
LEVEL_RECOMMENDATION = [
    ("Critical", "Escalate monitoring, validate sources, and prepare senior leadership briefings."),
    ("High", "Increase surveillance priority, track source corroboration, and monitor neighboring regions."),
    ("Medium", "Maintain enhanced monitoring and watch for changes in event frequency or severity."),
    ("Low", "Continue routine monitoring and keep the country on the baseline watch list."),
]

# ---- Fixed values: recommendation rules ----------------------------------------------
# (band_min, band_max_exclusive, order, category, action, priority, rationale template)
# ``{score}`` in a rationale is replaced by the country's score.
SCORE_BAND_RULES = [
    (75, 101, 1, "Force Protection", "Deploy rapid response teams to high-risk zones", "Critical",
     "Threat score {score}/100 indicates imminent or active threat conditions."),
    (75, 101, 2, "ISR", "Maximize UAV surveillance and satellite monitoring", "Critical",
     "Critical threat levels require continuous intelligence, surveillance, and reconnaissance."),
    (75, 101, 3, "Border Security", "Establish enhanced border checkpoints and patrols", "Critical",
     "High cross-border threat activity detected."),
    (75, 101, 4, "Command", "Prepare senior leadership briefings and escalation protocols", "Critical",
     "Critical situations require immediate command awareness."),
    (55, 75, 1, "ISR", "Increase UAV surveillance sorties by 50%", "High",
     "Threat score {score}/100 warrants enhanced monitoring."),
    (55, 75, 2, "Patrol", "Deploy additional ground patrols in vulnerable sectors", "High",
     "Elevated threat requires increased presence."),
    (55, 75, 3, "Intelligence", "Intensify HUMINT and SIGINT collection", "High",
     "High-threat environments benefit from multi-source intelligence fusion."),
    (30, 55, 1, "Monitoring", "Maintain enhanced monitoring cadence", "Elevated",
     "Threat score {score}/100 is above baseline — stay vigilant."),
    (30, 55, 2, "Coordination", "Coordinate with local security forces", "Elevated",
     "Medium-threat regions benefit from joint intelligence sharing."),
    (-1, 30, 1, "Baseline", "Continue routine monitoring and periodic assessments", "Routine",
     "Threat score {score}/100 is within normal parameters."),
]
# (order, terms, category, action, rationale template); ``{attack}`` = dominant type.
ATTACK_RULES = [
    (1, ("bombing", "explosion"), "EOD", "Pre-position explosive ordnance disposal teams",
     "Dominant attack type '{attack}' suggests IED/bombing risk."),
    (2, ("armed assault",), "Force Protection", "Reinforce perimeter security and access controls",
     "Dominant attack type '{attack}' indicates direct assault risk."),
    (3, ("assassination",), "VIP Protection", "Enhance protective details for key personnel",
     "Dominant attack type '{attack}' suggests targeted threats."),
    (4, ("kidnapping", "hostage"), "Personnel", "Restrict non-essential movement and travel",
     "Dominant attack type '{attack}' indicates abduction risk."),
]
TREND_UP = ("Analysis", "Investigate root causes of escalating activity",
            "Activity trend is increasing — proactive analysis recommended.")
TREND_DOWN = ("Assessment", "Consider gradual de-escalation of security posture", "Routine",
              "Activity trend is decreasing with moderate threat level.")
SURGE = ("Situational Awareness", "Activate real-time event monitoring cell",
         "{n} live conflict events detected — surge conditions.")
SURGE_MIN_EVENTS = 20

# ---- Fixed values: weather impact thresholds -----------------------------------------
WEATHER_RULES = dict(visibility_critical=1.0, visibility_degraded=5.0,
                     wind_critical=15.0, wind_degraded=8.0,
                     rain_critical=10.0, rain_degraded=2.0,
                     heat_critical=45.0, cold_critical=-15.0)

# ---- Fixed values: forecasting -------------------------------------------------------
ARIMA_ORDERS = [(1, 1, 1), (1, 1, 0), (0, 1, 1), (2, 1, 1), (1, 0, 1), (2, 1, 0),
                (1, 0, 0), (0, 1, 0), (0, 0, 0)]
Z80, Z95 = 1.2815515655446004, 1.959963984540054

# ---- Fixed values: similarity pseudo-documents ---------------------------------------
DOC_COLUMNS = ["country_txt", "region_txt", "attacktype1_txt", "weaptype1_txt",
               "targtype1_txt", "gname"]
DOC_SKIP = ["", "nan", "unknown"]
FATALITY_BANDS = [(0, "no_fatalities"), (5, "low_fatalities"), (20, "medium_fatalities")]
INJURY_BANDS = [(0, "no_injuries"), (10, "low_injuries"), (50, "medium_injuries")]
VOCAB_MIN_DF = 5
VOCAB_MAX_FEATURES = 3000

# ---- Fixed values: network profile categories ----------------------------------------
PROFILE_COLUMNS = ["region_txt", "attacktype1_txt", "weaptype1_txt", "targtype1_txt"]
