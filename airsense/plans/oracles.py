"""The same queries as plain SQL text for an independent engine."""

from airsense.functions.domain import AQI_SEGMENTS, WHO_LIMITS
from airsense.operators.eda import POLLUTANTS
from airsense.operators.model_sql import probability_sql
from airsense.plans.stored_models import STORED_MODELS
from airsense.schema import (
    ALERTS, BASELINE_COOCCURRENCE, BASELINE_MODEL, BASELINE_RATES, CIRCULAR_FEATURES,
    COMPOSITE_FEATURES, ENCODED_THEN_DROPPED, IMPUTED_COLUMNS, LABEL_TITLES, LABELS,
    LIVE_BASE_COLUMNS, LOGGED_COLUMNS, MISSING_FLAGS, NON_ID_COLUMNS, PROBS,
    QUALITY_FLAGS, READING_COLUMNS, READING_TYPES, RISK_FEATURES, RISKS, ROLLED_COLUMNS,
    ROLLING_FEATURES, SAMPLE_COLUMNS, THRESHOLDS, WEATHER_FEATURES,
)
from airsense.sources.driver_tables import DIGITS, PROB_SQL, READING_SQL

CLOCK = "timestamp '2024-02-01 08:30:00'"
TAU = "(2 * pi())"


def r(value: str, digits: int) -> str:
    return f"(round_even(({value}) * 1e{digits}, 0) / 1e{digits} + 0e0)"


def flag(condition: str) -> str:
    return f"(case when {condition} then 1 else 0 end)"


def share(part: str, whole: str) -> str:
    return f"coalesce(cast({part} as double) / nullif({whole}, 0), 0e0)"


def aqi(value: str) -> str:
    arms = " ".join(
        f"when {value} between {lo}e0 and {hi}e0 then "
        f"({b - a} / ({hi}e0 - {lo}e0)) * ({value} - {lo}e0) + {a}"
        for lo, hi, a, b in AQI_SEGMENTS
    )
    top = AQI_SEGMENTS[-1][1]
    return (
        f"cast(round_even(case when {value} > {top}e0 then 500e0 {arms} else 0e0 end, 0) as int)"
    )


def title(text: str) -> str:
    return f"(upper(substr(trim({text}), 1, 1)) || lower(substr(trim({text}), 2)))"


def cols(names) -> str:
    return ", ".join(names)


_content = ",\n  ".join(
    f"{sql.format(weekday='(isodow(ts) - 1)')} AS {name}" for name, sql in READING_SQL.items()
)
READINGS = f"""readings AS (
 SELECT 'RDG' || {DIGITS} AS reading_id,
  {_content}
 FROM events
 UNION ALL
 SELECT 'DUP' || {DIGITS} AS reading_id,
  {_content}
 FROM events WHERE event_id % 350 = 0)"""
DEDUPED = f"""deduped AS (
 SELECT min(reading_id) AS reading_id, {cols(NON_ID_COLUMNS)} FROM readings GROUP BY ALL)"""

_season = """case lower(trim(season)) when 'winter' then 'Winter' when 'spring' then 'Spring'
  when 'summer' then 'Summer' when 'fall' then 'Fall' when 'autumn' then 'Fall' else 'Unknown' end"""
_reference = aqi("pm25")
_pm10 = f"case when pm10 < pm25 then {r('pm25 * 1.5e0', 2)} else pm10 end"


def clean_from(source: str) -> str:
    replaced = {
        "season": _season,
        "station_type": f"coalesce({title('station_type')}, 'Unknown')",
        "pm10": _pm10,
    }
    columns = [f"{replaced[c]} AS {c}" if c in replaced else c for c in READING_COLUMNS]
    flags = [f"{flag(f'{c} is null')} AS {c}_missing" for c in IMPUTED_COLUMNS]
    gap = r(f"cast(aqi - {_reference} as double)", 2)
    return f"""(SELECT {', '.join(columns + flags)},
   {flag('pm10 < pm25')} AS pm10_adjusted_flag, {_reference} AS aqi_reference_pm25,
   {gap} AS aqi_gap, {flag(f'abs({gap}) > 30')} AS aqi_gap_flag,
   {flag('wind_speed_ms = 0')} AS wind_speed_zero_flag FROM {source})"""


CLEANED = f"cleaned AS {clean_from('readings')}"
CLEANED_ONCE = f"{DEDUPED},\ncleaned AS {clean_from('deduped')}"


def imputed(source: str) -> str:
    return f"""imputed AS (SELECT c.* REPLACE (
   coalesce(c.benzene, b.m, (SELECT median(benzene) FROM {source})) AS benzene,
   coalesce(c.pressure_hpa, p.m, (SELECT median(pressure_hpa) FROM {source})) AS pressure_hpa,
   coalesce(c.visibility_km, 1e0) AS visibility_km, coalesce(c.wind_dir_deg, 180e0) AS wind_dir_deg)
  FROM {source} c
  LEFT JOIN (SELECT station_type, median(benzene) m FROM {source} GROUP BY 1) b
   ON b.station_type = c.station_type
  LEFT JOIN (SELECT month, median(pressure_hpa) m FROM {source} GROUP BY 1) p ON p.month = c.month)"""


def with_scores(source: str, name: str = "scored") -> str:
    """Probabilities, alerts and summary on top of a relation."""
    probs = ", ".join(f"{sql} AS prob_{label}" for label, sql in PROB_SQL.items())
    alerts = ", ".join(
        f"{flag(f'{p} >= {THRESHOLDS[label]}e0')} AS {a}"
        for label, p, a in zip(LABELS, PROBS, ALERTS)
    )
    top = f"greatest({cols(PROBS)})"
    dominant = " ".join(f"when {p} = {top} then '{risk}'" for p, risk in zip(PROBS, RISKS))
    return f"""{name}_p AS (SELECT *, {probs} FROM {source}),
{name}_a AS (SELECT *, {alerts} FROM {name}_p),
{name} AS (SELECT *, {' + '.join(ALERTS)} AS total_alerts, {r(top, 4)} AS max_risk_prob,
  case {dominant} end AS dominant_risk, {' || '.join(f'cast({a} as varchar)' for a in ALERTS)}
  AS alert_signature, "timestamp" + interval 1 hour AS scored_at, 'fixture' AS model_version
  FROM {name}_a)"""


SCORED = f"{READINGS},\n{CLEANED},\n{with_scores('cleaned')}"


def over(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# ---- validation ----

CHECKS = {
    "pm10_less_than_pm25": "pm10 < pm25",
    "aqi_discrepancy_over_30": f"abs(aqi - {_reference}) > 30",
    "zero_wind_speed": "wind_speed_ms = 0",
    "extreme_o3_no2": "o3 > 200 and no2 > 200",
}
COUNTS = f"""counts AS (SELECT (SELECT count(*) FROM readings) AS total_rows,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM readings)) AS distinct_rows,
  (SELECT count(*) FROM (SELECT DISTINCT {cols(NON_ID_COLUMNS)} FROM readings)) AS distinct_content)"""
NUMERIC = [c for c in READING_COLUMNS if READING_TYPES[c].simpleString() in ("int", "double")]

ORACLES: dict[str, str] = {}
ORACLES["validation_counts"] = over(
    f"{READINGS}, {COUNTS}",
    f"""SELECT total_rows, {len(READING_COLUMNS)} AS total_columns,
 total_rows - distinct_rows AS duplicate_rows,
 total_rows - distinct_content AS duplicates_excluding_reading_id FROM counts""",
)
ORACLES["missing_profile"] = over(
    READINGS,
    union(
        f"""SELECT '{c}' AS column_name, '{READING_TYPES[c].simpleString()}' AS data_type,
 count({c}) AS non_null, count(*) - count({c}) AS missing,
 {r(f'cast(count(*) - count({c}) as double) / count(*)', 4)} AS missing_rate,
 {r(f'cast(count(*) - count({c}) as double) / count(*) * 100', 4)} AS missing_pct FROM readings"""
        for c in READING_COLUMNS
    ),
)
ORACLES["physical_checks"] = over(
    READINGS,
    union(
        f"SELECT '{n}' AS check_name, count(*) FILTER (WHERE {c}) AS \"rows\" FROM readings"
        for n, c in CHECKS.items()
    ),
)
ORACLES["validation_summary"] = over(
    f"{READINGS}, {COUNTS}",
    union(
        [
            f"SELECT 'overview' AS section, '{n}' AS metric, cast({e} as double) AS value FROM counts"
            for n, e in {
                "total_rows": "total_rows",
                "total_columns": str(len(READING_COLUMNS)),
                "duplicate_rows": "total_rows - distinct_rows",
                "duplicates_excluding_reading_id": "total_rows - distinct_content",
            }.items()
        ]
        + [
            f"SELECT 'missing_values', '{c}', cast(count(*) - count({c}) as double) FROM readings"
            for c in READING_COLUMNS
        ]
        + [
            f"SELECT 'missing_rates', '{c}', {r(f'cast(count(*) - count({c}) as double) / count(*)', 4)} FROM readings"
            for c in READING_COLUMNS
        ]
        + [
            f"SELECT 'physical_checks', '{n}', cast(count(*) FILTER (WHERE {c}) as double) FROM readings"
            for n, c in CHECKS.items()
        ]
    ),
)
_violations = {
    "season": "season is null or season not in ('Winter', 'Spring', 'Summer', 'Fall')",
    "station_type": f"station_type is distinct from {title('station_type')}",
    **{c: f"{c} is null" for c in IMPUTED_COLUMNS},
    "pm10": CHECKS["pm10_less_than_pm25"],
    "aqi": CHECKS["aqi_discrepancy_over_30"],
    "wind_speed_ms": CHECKS["zero_wind_speed"],
}
RULE_TEXTS = {
    "season": "Four season names in title case; Autumn becomes Fall",
    "station_type": "Trimmed and in title case",
    "benzene": "Missing values are flagged and take the median of the station type",
    "visibility_km": "Missing values are flagged and become 1.0",
    "wind_dir_deg": "Missing values are flagged and become 180 degrees",
    "pressure_hpa": "Missing values are flagged and take the median of the month",
    "pm10": "A value below pm25 is replaced by pm25 times 1.5",
    "aqi": "Flagged where it is over 30 away from the index of pm25",
    "wind_speed_ms": "Flagged where it is exactly zero",
}
ORACLES["rule_catalogue"] = over(
    READINGS,
    union(
        f"SELECT '{c}' AS column_name, '{text}' AS \"rule\", "
        f"count(*) FILTER (WHERE {_violations[c]}) AS \"rows\" FROM readings"
        for c, text in RULE_TEXTS.items()
    ),
)
ORACLES["duplicate_groups"] = over(
    READINGS,
    f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {cols(NON_ID_COLUMNS)}) AS group_size
 FROM readings) WHERE group_size > 1""",
)
ORACLES["problem_rows"] = over(
    READINGS,
    f"""SELECT reading_id, "timestamp", station_id, station_type, season, pm25, pm10, no2, o3, aqi,
 wind_speed_ms FROM readings WHERE {' OR '.join(f'({c})' for c in CHECKS.values())}""",
)
ORACLES["numeric_profile"] = over(
    READINGS,
    union(
        f"SELECT '{c}' AS column_name, count({c}) AS \"count\", "
        + ", ".join(
            f"{r(f'cast({e} as double)', 6)} AS {n}"
            for n, e in {
                "mean": f"avg({c})",
                "std": f"stddev_samp({c})",
                "min": f"min({c})",
                "max": f"max({c})",
                "q25": f"quantile_cont({c}, 0.25)",
                "q50": f"quantile_cont({c}, 0.5)",
                "q75": f"quantile_cont({c}, 0.75)",
            }.items()
        )
        + " FROM readings"
        for c in NUMERIC
    ),
)
ORACLES["quality_summary"] = over(
    f"{READINGS}, {COUNTS}",
    union(
        [
            "SELECT 1 AS line_no, 'Rows: ' || format('{:,}', total_rows) AS line FROM counts",
            f"SELECT 2, 'Columns: {len(READING_COLUMNS)}'",
            "SELECT 3, 'Duplicate rows excluding reading_id: ' || cast(total_rows - distinct_content as varchar) FROM counts",
        ]
        + [
            f"SELECT {n}, '{text}' || cast(count(*) FILTER (WHERE {CHECKS[c]}) as varchar) FROM readings"
            for n, text, c in (
                (4, "PM10 < PM2.5 rows: ", "pm10_less_than_pm25"),
                (5, "AQI mismatch rows: ", "aqi_discrepancy_over_30"),
                (6, "Wind speed = 0.0 rows: ", "zero_wind_speed"),
            )
        ]
    ),
)
_mask = " || ".join(f"{flag(f'{c} is null')}::varchar" for c in READING_COLUMNS)
ORACLES["null_masks"] = over(
    READINGS, f'SELECT {_mask} AS null_mask, count(*) AS "rows" FROM readings GROUP BY 1'
)

# ---- cleaning ----

ORACLES["aqi_reference"] = over(
    READINGS, f"SELECT reading_id, pm25, {_reference} AS aqi_reference_pm25 FROM readings"
)
ORACLES["dedupe_first"] = over(
    f"{READINGS}, {DEDUPED}", f"SELECT {cols(READING_COLUMNS)} FROM deduped"
)
_cleaned = {
    "clean_categories": ("reading_id", "season", "station_type"),
    "missing_flags": ("reading_id", *MISSING_FLAGS),
    "sensor_quality_flags": (
        "reading_id", "pm10_adjusted_flag", "aqi_reference_pm25", "aqi_gap", "aqi_gap_flag",
        "wind_speed_zero_flag",
    ),
    "repair_pm10": ("reading_id", "pm25", "pm10"),
}
for _name, _columns in _cleaned.items():
    ORACLES[_name] = over(f"{READINGS}, {CLEANED}", f"SELECT {cols(_columns)} FROM cleaned")
ORACLES["impute_domain"] = over(
    f"{READINGS}, {CLEANED}, {imputed('cleaned')}",
    f"SELECT reading_id, {cols(IMPUTED_COLUMNS)} FROM imputed",
)
PREPROCESSED = f"{READINGS}, {CLEANED_ONCE}, {imputed('cleaned')}"
ORACLES["preprocess"] = over(PREPROCESSED, "SELECT * FROM imputed")

# ---- features ----

_wind = "radians(coalesce(wind_dir_deg, 180e0))"
_not_less = "case when {c} is not null then greatest({c}, {floor}) end"
FEATURE_SQL = {
    **{
        f"{n}_{f}": r(f"{f}({angle})", 4)
        for n, angle in {
            "hour": f"{TAU} * hour / 24", "month": f"{TAU} * month / 12", "wind": _wind,
        }.items()
        for f in ("sin", "cos")
    },
    "pm_fine_ratio": r(f"pm25 / ({_not_less.format(c='pm10', floor='0.1e0')})", 3),
    "oxidant_load": r("o3 + no2", 1),
    "combustion_index": r("no2 * 0.6e0 + co * 10", 2),
    "industrial_signature": r("so2 * 0.5e0 + coalesce(benzene, 0) * 3", 2),
    "aqi_excess_150": _not_less.format(c="(aqi - 150)", floor=0),
    "aqi_excess_100": _not_less.format(c="(aqi - 100)", floor=0),
    **{f"log_{c}": r(f"ln(1 + coalesce({c}, 0))", 6) for c in LOGGED_COLUMNS},
    "dispersion_index": r("wind_speed_ms / (1 + temp_inversion * 3)", 3),
    "precipitation_flag": flag("precipitation_mm > 0"),
    "heavy_rain": flag("precipitation_mm > 5"),
    "heat_ozone_risk": flag("temp_c > 25 and o3 > 100"),
    "inversion_severity": r(
        f"temp_inversion * (1e0 / ({_not_less.format(c='wind_speed_ms', floor='0.5e0')}))"
        " * (humidity_pct / 100)",
        3,
    ),
    "haze_flag": flag("coalesce(visibility_km, 1e0) < 5"),
    "urban_heat": flag("station_type = 'Urban' and temp_c > 28"),
    "industrial_downwind": flag(
        "near_industry = 1 and coalesce(wind_dir_deg, 180e0) between 180 and 315"
    ),
    "urban_rush": flag("station_type = 'Urban' and is_rush_hour = 1"),
    "pm25_cardio_zone": flag("pm25 > 55.4e0"),
    "multi_label_event": flag("aqi > 150"),
    "pollutants_above_who": " + ".join(flag(f"{c} > {v}e0") for c, v in WHO_LIMITS.items()),
}


def pick(names) -> str:
    return ", ".join(f"{FEATURE_SQL[n]} AS {n}" for n in names)


for _name, _columns in {
    "features_circular": CIRCULAR_FEATURES,
    "features_composite": COMPOSITE_FEATURES,
    "features_weather": WEATHER_FEATURES,
    "features_risk": RISK_FEATURES,
}.items():
    ORACLES[_name] = over(
        f"{READINGS}, {CLEANED}", f"SELECT reading_id, {pick(_columns)} FROM cleaned"
    )


def rolled(source: str) -> str:
    means = ", ".join(f"{r(f'avg({c}) OVER w3', 2)} AS {c}_roll3_mean" for c in ROLLED_COLUMNS)
    lags = ", ".join(f"lag({c}) OVER w AS {c}_lag1" for c in ROLLED_COLUMNS)
    trends = ", ".join(f"{r(f'{c} - {c}_roll3_mean', 2)} AS {c}_trend" for c in ROLLED_COLUMNS)
    order = 'PARTITION BY station_id ORDER BY "timestamp" ASC NULLS LAST, reading_id'
    return f"""rolled_means AS (SELECT *, {means}, {lags} FROM {source}
  WINDOW w AS ({order}), w3 AS ({order} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
rolled_trends AS (SELECT *, {trends} FROM rolled_means),
rolled AS (SELECT *, {flag('pm25_trend > 5')} AS pm25_rising FROM rolled_trends)"""


ORACLES["features_rolling"] = over(
    f"{READINGS}, {rolled('readings')}", f"SELECT reading_id, {cols(ROLLING_FEATURES)} FROM rolled"
)
ORACLES["stream_rolling"] = over(
    f"{READINGS}, {rolled('readings')}",
    f'SELECT reading_id, station_id, "timestamp", {cols(ROLLING_FEATURES)}, false AS late FROM rolled',
)
ORACLES["feature_frame"] = over(
    f"{PREPROCESSED}, {rolled('imputed')}",
    f"SELECT * EXCLUDE ({cols(ENCODED_THEN_DROPPED)}), {pick(FEATURE_SQL)} FROM rolled",
)
ORACLES["feature_sample"] = over(
    f"{READINGS}, {CLEANED}, {rolled('cleaned')}, framed AS (SELECT *, "
    f"{pick(('pm_fine_ratio', 'oxidant_load', 'dispersion_index'))} FROM rolled)",
    f"""SELECT {cols(SAMPLE_COLUMNS)} FROM framed
 ORDER BY station_id, "timestamp", reading_id LIMIT 100""",
)

# ---- live path ----

_n = "cast(substr(reading_id, 4) as bigint)"
_season_of_month = """case when {m} in (12, 1, 2) then 'Winter' when {m} in (3, 4, 5) then 'Spring'
 when {m} in (6, 7, 8) then 'Summer' else 'Fall' end"""


def calendar(ts: str, rush: str = "7, 8, 9, 16, 17, 18, 19") -> dict[str, str]:
    return {
        "year": f"cast(year({ts}) as int)",
        "month": f"cast(month({ts}) as int)",
        "hour": f"cast(hour({ts}) as int)",
        "day_of_week": f"cast(isodow({ts}) - 1 as int)",
        "is_weekend": flag(f"isodow({ts}) >= 6"),
        "is_rush_hour": flag(f"hour({ts}) in ({rush})"),
        "season": _season_of_month.format(m=f"month({ts})"),
    }


def named(expressions: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in expressions.items())


_sent = {c: f'"{c}"' for c in LIVE_BASE_COLUMNS}
_sent |= {
    "pm25": f"case when {_n} % 17 <> 0 then pm25 end",
    "timestamp": f'case when {_n} % 23 <> 0 then "timestamp" else {CLOCK} end',
    "reading_id": f"case when {_n} % 19 <> 0 then reading_id else 'generated' end",
}
_labels_unknown = {label: "cast(null as int)" for label in LABELS}
ORACLES["live_normalise"] = over(
    f"{READINGS}, sent AS (SELECT reading_id AS source, {named(_sent)} FROM readings"
    f" WHERE {_n} % 13 <> 0)",
    "SELECT source, 0 AS payload_position, "
    + cols(f'"{c}"' for c in LIVE_BASE_COLUMNS)
    + ", "
    + named(calendar('"timestamp"') | _labels_unknown)
    + " FROM sent",
)
ORACLES["live_reject"] = over(
    READINGS,
    f"SELECT reading_id AS source, 'Missing required fields: co' AS error FROM readings"
    f" WHERE {_n} % 13 = 0",
)
_size = f"case when {_n} % 50 = 0 then 101 when {_n} % 51 = 0 then 0 else 1 + {_n} % 3 end"
_form = ("pm25", "pm10", "aqi", "temp_c", "humidity_pct", "season", "station_type")
_requested = {
    "reading_id": "printf('BATCH_%04d', position)",
    "timestamp": CLOCK,
    **calendar(CLOCK, "7, 8, 9, 17, 18, 19"),
    **{
        c: f"cast(null as {'varchar' if READING_TYPES[c].simpleString() == 'string' else READING_TYPES[c].simpleString()})"
        for c in READING_COLUMNS
        if c not in ("reading_id", "timestamp") and c not in calendar(CLOCK)
    },
    **{c: c for c in _form},
    "wind_dir_deg": "case when n % 2 = 0 and wind_dir_deg is not null then wind_dir_deg else 180e0 end",
}
ORACLES["batch_request_rows"] = over(
    f"""{READINGS}, requests AS (SELECT {_n} AS n, {_size} AS size, * FROM readings),
 expanded AS (SELECT *, unnest(range(size)) AS position FROM requests WHERE size BETWEEN 1 AND 100)""",
    f"SELECT reading_id AS request_id, {named({c: _requested[c] for c in READING_COLUMNS})} FROM expanded",
)
ORACLES["batch_request_errors"] = over(
    READINGS,
    f"""SELECT reading_id AS request_id, case when {_n} % 50 = 0 then 'Batch limit is 100 rows'
 else 'No rows provided' end AS error FROM readings WHERE {_n} % 50 = 0 or {_n} % 51 = 0""",
)
ORACLES["payload_defaults"] = over(
    READINGS,
    """SELECT reading_id, coalesce(pm25, 0) AS pm25, coalesce(pm10, 0) AS pm10,
 coalesce(aqi, 0) AS aqi, coalesce(nullif(temp_c, 0), 20) AS temp_c,
 coalesce(nullif(humidity_pct, 0), 50) AS humidity_pct,
 coalesce(nullif(wind_speed_ms, 0), 2) AS wind_speed_ms,
 coalesce(season, 'Spring') AS season, coalesce(station_type, 'Urban') AS station_type,
 coalesce(pressure_hpa, 1013) AS pressure_hpa, coalesce(visibility_km, 10) AS visibility_km,
 coalesce(benzene, 1) AS benzene, coalesce(wind_dir_deg, 180) AS wind_dir_deg,
 0e0 AS precipitation_mm, 0 AS temp_inversion, 100e0 AS elevation_m, 0 AS near_highway,
 0 AS near_industry, 1e0 AS co, 30e0 AS no2, 50e0 AS o3, 5e0 AS so2, 'BATCH_AUTO' AS station_id
 FROM readings""",
)
ORACLES["single_request"] = over(
    READINGS,
    f"""SELECT reading_id AS source, pm25, benzene, 180e0 AS wind_dir_deg,
 'USR_' || cast(cast(epoch({CLOCK}) as bigint) as varchar) AS reading_id FROM readings""",
)
_calendar_of_reading = named(calendar('"timestamp"'))
ORACLES["temporal_columns"] = over(
    READINGS, f"SELECT reading_id, {_calendar_of_reading} FROM readings"
)
ORACLES["season_from_month"] = over(
    READINGS,
    f"SELECT reading_id, month, {_season_of_month.format(m='month')} AS season FROM readings",
)
WRITES = f"""writes AS (SELECT station_id || '-' || lpad(cast(hour as varchar), 2, '0') AS reading_id,
  station_id, "timestamp", pm25, aqi, reading_id AS written_as, {_n} AS sequence,
  case when day("timestamp") > 15 then 1.5e0 end AS co FROM readings)"""
ORACLES["upsert_last_wins"] = over(
    f"{READINGS}, {WRITES}",
    """SELECT * EXCLUDE (recency) FROM (SELECT *, row_number() OVER (PARTITION BY reading_id
 ORDER BY sequence DESC, written_as DESC) AS recency FROM writes) WHERE recency = 1""",
)
ORACLES["history_append"] = over(
    f"{READINGS}, {WRITES}",
    """SELECT station_id, count(*) AS "rows", min(sequence) AS first_sequence,
 max(sequence) AS last_sequence FROM writes GROUP BY 1""",
)
ORACLES["history_tail"] = over(
    SCORED,
    """SELECT reading_id, station_id, scored_at, total_alerts, alert_signature FROM scored
 ORDER BY scored_at DESC, reading_id DESC LIMIT 20""",
)
ORACLES["active_source"] = over(
    SCORED, "SELECT reading_id, total_alerts FROM scored WHERE total_alerts > 0"
)
ORACLES["csv_round_trip"] = over(READINGS, f"SELECT {cols(READING_COLUMNS)} FROM readings")

# ---- scoring ----

ORACLES["score_alerts"] = over(
    SCORED, f"SELECT reading_id, {cols(PROBS)}, {cols(ALERTS)} FROM scored"
)
ORACLES["score_summary"] = over(
    SCORED,
    """SELECT reading_id, total_alerts, max_risk_prob, dominant_risk, alert_signature, scored_at,
 model_version FROM scored""",
)
ORACLES["alert_signature"] = over(
    SCORED, 'SELECT alert_signature, count(*) AS "rows" FROM scored GROUP BY 1'
)
ORACLES["predictions_backfill"] = over(
    SCORED, "SELECT reading_id, max_risk_prob, dominant_risk, alert_signature FROM scored"
)
ORACLES["ingest_response"] = over(
    SCORED,
    "SELECT reading_id, station_id, total_alerts, max_risk_prob, dominant_risk FROM scored",
)

# ---- monitoring ----

_risk_title = (
    "case dominant_risk "
    + " ".join(f"when '{n}' then '{LABEL_TITLES[f'label_{n}']}'" for n in RISKS)
    + " end"
)
_iso = "strftime({c}, '%Y-%m-%dT%H:%M:%S')"
OVERVIEW = f"""overview AS (SELECT count(*) AS readings_scored, count(DISTINCT station_id) AS stations_seen,
  count(*) FILTER (WHERE total_alerts > 0) AS active_alert_rows, max("timestamp") AS latest_timestamp,
  max(scored_at) AS latest_scored_at, {r('avg(aqi)', 2)} AS avg_aqi,
  {r('avg(total_alerts)', 2)} AS avg_total_alerts, {r('max(max_risk_prob)', 4)} AS max_risk_prob
  FROM scored)"""
STATIONS = f"""stations AS (SELECT station_id, station_type, {r('cast(aqi as double)', 1)} AS aqi,
  total_alerts, max_risk_prob, {_risk_title} AS dominant_risk, {' + '.join(QUALITY_FLAGS)} AS quality_flags
  FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY "timestamp" DESC, reading_id) AS k
   FROM scored WHERE station_id IS NOT NULL AND "timestamp" IS NOT NULL) WHERE k = 1)"""
LABEL_DRIFT = "label_drift AS (" + union(
    f"""SELECT '{label}' AS label, '{LABEL_TITLES[label]}' AS display_name,
  {r(f'avg({a})', 4)} AS current_rate, {r(f'{BASELINE_RATES[label]}e0', 4)} AS training_rate,
  {r(f'avg({a}) - {BASELINE_RATES[label]}e0', 4)} AS rate_gap FROM scored"""
    for label, a in zip(LABELS, ALERTS)
) + ")"
_flagged = f"({' + '.join(QUALITY_FLAGS)}) > 0"
_quality = r(f"avg({flag(_flagged)})", 4)
_deltas = " + ".join(
    f"abs(cast(sum({ALERTS[i]} * {ALERTS[j]}) as double) / count(*) - {BASELINE_COOCCURRENCE[i][j]}e0)"
    for i in range(5)
    for j in range(5)
)
_gap = r(f"({_deltas}) / 25", 4)
SUMMARY = f"""summary AS (SELECT {_quality} AS quality_flag_rate, {_gap} AS cooccurrence_gap,
  '{BASELINE_MODEL['selected_model']}' AS model, {r(f"{BASELINE_MODEL['hamming_loss']}e0", 4)} AS test_hamming_loss,
  {r(f"{BASELINE_MODEL['f1_macro']}e0", 4)} AS test_f1_macro,
  {r(f"{BASELINE_MODEL['exact_match']}e0", 4)} AS test_exact_match FROM scored)"""

ORACLES["overview"] = over(f"{SCORED}, {OVERVIEW}", "SELECT * FROM overview")
ORACLES["recent_alerts"] = over(
    SCORED,
    f"""SELECT reading_id, station_id, station_type, {r('cast(aqi as double)', 1)} AS aqi, total_alerts,
 {_risk_title} AS dominant_risk, max_risk_prob, {_iso.format(c='"timestamp"')} AS "timestamp",
 {_iso.format(c='scored_at')} AS scored_at
 FROM (SELECT * FROM scored WHERE total_alerts > 0
  ORDER BY max_risk_prob DESC, aqi DESC, total_alerts DESC, reading_id LIMIT 8)""",
)
ORACLES["station_summary"] = over(f"{SCORED}, {STATIONS}", "SELECT * FROM stations")
ORACLES["timeline"] = over(
    SCORED,
    f"""SELECT "timestamp", {r('avg(aqi)', 2)} AS avg_aqi, {r('avg(total_alerts)', 2)} AS avg_total_alerts,
 {r('max(max_risk_prob)', 4)} AS max_risk_prob, count(*) FILTER (WHERE total_alerts > 0) AS active_rows
 FROM scored WHERE "timestamp" IN (SELECT DISTINCT "timestamp" FROM scored ORDER BY 1 DESC LIMIT 24)
 GROUP BY 1""",
)
ORACLES["label_drift"] = over(f"{SCORED}, {LABEL_DRIFT}", "SELECT * FROM label_drift")
ORACLES["quality_flag_rate"] = over(
    f"{SCORED}, {SUMMARY}", "SELECT quality_flag_rate FROM summary"
)
ORACLES["cooccurrence"] = over(
    READINGS,
    union(
        f"""SELECT '{a}' AS row_label, '{b}' AS col_label,
 {r(f'cast(sum({a} * {b}) as double) / count(*)', 4)} AS share FROM readings"""
        for a in LABELS
        for b in LABELS
    ),
)
ORACLES["cooccurrence_gap"] = over(f"{SCORED}, {SUMMARY}", "SELECT cooccurrence_gap FROM summary")
ORACLES["monitoring_summary"] = over(f"{SCORED}, {SUMMARY}", "SELECT * FROM summary")
_numbers = ("readings_scored", "stations_seen", "active_alert_rows", "avg_aqi", "avg_total_alerts",
            "max_risk_prob")
ORACLES["monitoring_report"] = over(
    f"{SCORED}, {OVERVIEW}, {STATIONS}, {LABEL_DRIFT}, {SUMMARY}",
    union(
        [
            f"SELECT 'overview' AS section, '{c}' AS metric, cast(null as varchar) AS value,"
            f" cast({c} as double) AS value_num FROM overview"
            for c in _numbers
        ]
        + [
            f"SELECT 'overview', '{c}', {_iso.format(c=c)}, null FROM overview"
            for c in ("latest_timestamp", "latest_scored_at")
        ]
        + [
            f"SELECT 'label', label || '_{c}', null, {c} FROM label_drift"
            for c in ("current_rate", "training_rate", "rate_gap")
        ]
        + [
            f"SELECT 'monitoring', '{c}', null, {c} FROM summary"
            for c in ("quality_flag_rate", "cooccurrence_gap", "test_hamming_loss",
                      "test_f1_macro", "test_exact_match")
        ]
        + ["SELECT 'monitoring', 'model', model, null FROM summary"]
        + [
            """SELECT 'station', station_id || '_max_risk_prob', null, max_risk_prob FROM
 (SELECT * FROM stations ORDER BY max_risk_prob DESC, aqi DESC, station_id LIMIT 6)"""
        ]
    ),
)


def snapshot_fields(section: str, source: str, item: str, numbers, texts) -> list[str]:
    """A section's rows field by field; ``numbers`` and ``texts`` map fields to expressions."""
    cells = [(f, f"cast({e} as double)", "cast(null as varchar)", e) for f, e in numbers.items()]
    cells += [(f, "cast(null as double)", f"cast({e} as varchar)", e) for f, e in texts.items()]
    return [
        f"SELECT '{section}' AS section, {item} AS item, '{f}' AS field, {n} AS number, {t} AS text FROM {source} WHERE ({e}) IS NOT NULL"
        for f, n, t, e in cells
    ]


def itself(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_times = {c: _iso.format(c=c) for c in ("latest_timestamp", "latest_scored_at")}
ORACLES["dashboard_snapshot"] = over(
    f"{SCORED}, {OVERVIEW}, {STATIONS}, {LABEL_DRIFT}, {SUMMARY}, alerts AS ({ORACLES['recent_alerts'][len('WITH ' + SCORED):]}), "
    f"timeline AS ({ORACLES['timeline'][len('WITH ' + SCORED):]})",
    union(
        snapshot_fields("status", "overview, (SELECT epoch_us(max(scored_at)) || ':' || count(*) AS signature FROM scored)", "''", {},
                        {"status": "'ok'", "generated_at": "'2024-02-01T08:30:00'", "data_signature": "signature"})
        + snapshot_fields("overview", "overview", "''", itself(*_numbers), _times)
        + snapshot_fields("alerts", "alerts", "reading_id", itself("aqi", "total_alerts", "max_risk_prob"),
                          itself("reading_id", "station_id", "station_type", "dominant_risk", '"timestamp"', "scored_at"))
        + snapshot_fields("stations", "stations", "station_id", itself("aqi", "total_alerts", "max_risk_prob", "quality_flags"),
                          itself("station_id", "station_type", "dominant_risk"))
        + snapshot_fields("timeline", "timeline", _iso.format(c='"timestamp"'), itself("avg_aqi", "avg_total_alerts", "max_risk_prob", "active_rows"),
                          {"timestamp": _iso.format(c='"timestamp"')})
        + snapshot_fields("labels", "label_drift", "label", itself("current_rate", "training_rate", "rate_gap"), itself("label", "display_name"))
        + snapshot_fields("monitoring", "summary", "''", itself("quality_flag_rate", "cooccurrence_gap", "test_hamming_loss", "test_f1_macro", "test_exact_match"),
                          itself("model"))
        + snapshot_fields("model", "overview", "''", {}, {
            "selected_model": "'random_forest'", "thresholds": "'{}'",
            "metrics": """'{"hamming_loss":0.0358,"f1_macro":0.9406409861019375,"exact_match":0.834}'""",
        })
    ).replace("'\"timestamp\"' AS field", "'timestamp' AS field"),
)
ORACLES["health_slice"] = over(
    f"{SCORED}, {OVERVIEW}",
    """SELECT case when readings_scored > 0 then 'ok' else 'no_predictions' end AS status,
 readings_scored AS latest_predictions_count, latest_scored_at FROM overview""",
)
ORACLES["alerts_slice"] = over(
    f"{SCORED}, {STATIONS}",
    """SELECT count(*) AS stations_total, count(*) FILTER (WHERE total_alerts > 0)
 AS stations_with_alerts FROM stations""",
)
_severity = "case when max_risk_prob >= {t}e0 then 'high' else 'normal' end AS severity"
ORACLES["station_bands"] = over(
    f"{SCORED}, {STATIONS}",
    f"""SELECT station_id, max_risk_prob, {_severity.format(t=0.8)} FROM stations
 ORDER BY max_risk_prob DESC, aqi DESC, station_id LIMIT 6""",
)
ORACLES["risk_bands"] = over(
    SCORED,
    f'SELECT station_id, {_severity.format(t=0.7)}, count(*) AS "rows" FROM scored GROUP BY 1, 2',
)

# ---- evaluation ----

PLACED = """placed AS (SELECT *, row_number() OVER (ORDER BY "timestamp" NULLS LAST, station_id, reading_id)
  - 1 AS place, count(*) OVER () AS n FROM readings)"""
_test_start = "cast(floor(n * (1 - 0.2e0)) as bigint)"
_validation_start = f"greatest({_test_start} - greatest(cast(floor(n * 0.1e0) as bigint), 125), 0)"
ORACLES["time_split"] = over(
    f"{READINGS}, {PLACED}",
    f"""SELECT reading_id, case when place < {_validation_start} then 'train'
 when place < {_test_start} then 'validation' else 'test' end AS split FROM placed""",
)
ORACLES["time_split_two_way"] = over(
    f"{READINGS}, {PLACED}",
    f"""SELECT case when place < {_test_start} then 'train' else 'test' end AS split,
 count(*) AS "rows", min("timestamp") AS since FROM placed GROUP BY 1""",
)


def curve(steps: int, start: float) -> str:
    grid = f"grid AS (SELECT cast(i as int) AS step, {start}e0 + i * 0.05e0 AS threshold FROM range({steps}) t(i))"
    long = "long AS (" + union(
        f"SELECT '{label}' AS label, {label} AS y, prob_{label} AS p FROM scored" for label in LABELS
    ) + ")"
    return f"""{grid}, {long}, curve AS (SELECT label, step, threshold,
  count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp,
  count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp,
  count(*) FILTER (WHERE p < threshold AND y = 1) AS fn FROM long, grid GROUP BY 1, 2, 3),
 scores AS (SELECT *, {share('2 * tp', '2 * tp + fp + fn')} AS f1 FROM curve)"""


SCORED_RAW = f"{READINGS},\n{with_scores('readings')}"
ORACLES["threshold_curve"] = over(
    f"{SCORED_RAW}, {curve(13, 0.2)}",
    f"SELECT label, step, {r('threshold', 6)} AS threshold, tp, fp, fn, {r('f1', 6)} AS f1 FROM scores",
)


def tuning(steps: int, start: float, middle: bool) -> str:
    better = "s.f1 > b.score"
    kept = "s.threshold"
    if middle:
        better = (
            f"({better} or (abs(s.f1 - b.score) <= 1e-8 + 1e-5 * abs(b.score)"
            " and abs(s.threshold - 0.5e0) < abs(b.threshold - 0.5e0)))"
        )
        kept = r("s.threshold", 2)
    shown = "threshold" if middle else r("threshold", 6)
    return f"""WITH RECURSIVE {SCORED_RAW}, {curve(steps, start)},
 best AS (SELECT DISTINCT label, -1 AS step, 0.5e0 AS threshold, -1e0 AS score FROM scores
  UNION ALL
  SELECT b.label, s.step, case when {better} then {kept} else b.threshold end,
   case when {better} then s.f1 else b.score end
  FROM best b JOIN scores s ON s.label = b.label AND s.step = b.step + 1)
SELECT label, {shown} AS threshold, {r('score', 4)} AS score FROM best WHERE step = {steps - 1}"""


ORACLES["threshold_tuning"] = tuning(13, 0.2, True)
ORACLES["threshold_tuning_strict"] = tuning(16, 0.1, False)


def metric_counts(thresholds: dict[str, float]) -> str:
    parts = ["count(*) AS n"]
    preds = {
        label: flag(f"prob_{label} >= {t}e0") for label, t in thresholds.items()
    }
    for i, label in enumerate(LABELS):
        p = preds[label]
        parts += [
            f"count(*) FILTER (WHERE {label} = 1 AND {p} = 1) AS tp_{i}",
            f"count(*) FILTER (WHERE {label} = 0 AND {p} = 1) AS fp_{i}",
            f"count(*) FILTER (WHERE {label} = 1 AND {p} = 0) AS fn_{i}",
        ]
    exact = " AND ".join(f"{label} = {preds[label]}" for label in LABELS)
    both = " + ".join(f"{label} * {preds[label]}" for label in LABELS)
    either = " + ".join(f"greatest({label}, {preds[label]})" for label in LABELS)
    parts.append(f"count(*) FILTER (WHERE {exact}) AS exact")
    parts.append(f"avg({share(both, either)}) AS jaccard")
    return f"SELECT {', '.join(parts)} FROM scored"


def _f1(tp: str, fp: str, fn: str) -> str:
    return share(f"2 * ({tp})", f"2 * ({tp}) + ({fp}) + ({fn})")


_sum = {k: " + ".join(f"{k}_{i}" for i in range(5)) for k in ("tp", "fp", "fn")}
OVERALL = {
    "hamming_loss": share(f"{_sum['fp']} + {_sum['fn']}", "n * 5"),
    "f1_micro": _f1(_sum["tp"], _sum["fp"], _sum["fn"]),
    "f1_macro": "(" + " + ".join(_f1(f"tp_{i}", f"fp_{i}", f"fn_{i}") for i in range(5)) + ") / 5",
    "exact_match": share("exact", "n"),
    "jaccard_samples": "jaccard",
}
_per_label = {}
for _i, _label in enumerate(LABELS):
    _per_label[("precision", _label)] = share(f"tp_{_i}", f"tp_{_i} + fp_{_i}")
    _per_label[("recall", _label)] = share(f"tp_{_i}", f"tp_{_i} + fn_{_i}")
    _per_label[("f1", _label)] = _f1(f"tp_{_i}", f"fp_{_i}", f"fn_{_i}")
ORACLES["multilabel_metrics"] = over(
    f"{SCORED_RAW}, m AS ({metric_counts(THRESHOLDS)})",
    union(
        f"SELECT '{metric}' AS metric, '{label}' AS label, {r(e, 6)} AS value FROM m"
        for (metric, label), e in (
            {(n, "all"): e for n, e in OVERALL.items()} | _per_label
        ).items()
    ),
)
ORACLES["label_rates"] = over(
    READINGS,
    union(
        f"SELECT '{c}' AS label, {r(f'avg({c})', 4)} AS rate FROM readings" for c in LABELS
    ),
)
ORACLES["class_weights"] = over(
    READINGS,
    union(
        f"""SELECT '{c}' AS label, {v} AS class_value, count(*) FILTER (WHERE {c} = {v}) AS class_rows,
 {r(f'cast(count(*) as double) / (2 * count(*) FILTER (WHERE {c} = {v}))', 6)} AS weight FROM readings"""
        for c in LABELS
        for v in (0, 1)
    ),
)
_candidates = {
    "shipped": THRESHOLDS,
    "low": dict.fromkeys(LABELS, 0.3),
    "high": dict.fromkeys(LABELS, 0.7),
}
COMPARED = "compared AS (" + union(
    f"SELECT '{n}' AS model, {', '.join(f'{e} AS {m}' for m, e in OVERALL.items())} FROM ({metric_counts(t)})"
    for n, t in _candidates.items()
) + ")"
_all_counts = ", ".join(f"({metric_counts(t)}) AS m_{n}" for n, t in _candidates.items())
ORACLES["per_label_f1"] = over(
    SCORED_RAW,
    union(
        f"SELECT '{label}' AS label, "
        + ", ".join(
            f"{r(_f1(f'm_{n}.tp_{i}', f'm_{n}.fp_{i}', f'm_{n}.fn_{i}'), 6)} AS {n}"
            for n in _candidates
        )
        + f" FROM {_all_counts}"
        for i, label in enumerate(LABELS)
    ),
)
_rounded_metrics = ", ".join(f"{r(m, 6)} AS {m}" for m in OVERALL)
ORACLES["model_comparison"] = over(
    f"{SCORED_RAW}, {COMPARED}", f"SELECT model, {_rounded_metrics} FROM compared"
)
ORACLES["model_selection"] = over(
    f"{SCORED_RAW}, {COMPARED}, best AS (SELECT * FROM compared ORDER BY hamming_loss, f1_macro DESC,"
    " exact_match DESC, f1_micro DESC, model LIMIT 1)",
    f"SELECT model, {_rounded_metrics} FROM best",
)
ORACLES["preprocessor_stats"] = over(
    READINGS,
    union(
        f"""SELECT '{c}' AS column_name, {r('any_value(m)', 6)} AS median, {r('avg(v)', 6)} AS mean,
 {r('case when stddev_pop(v) > 0 then stddev_pop(v) else 1 end', 6)} AS scale
 FROM (SELECT coalesce(cast({c} as double), m) AS v, m FROM readings,
  (SELECT cast(median({c}) as double) AS m FROM readings))"""
        for c in NUMERIC
    ),
)
ORACLES["category_modes"] = over(
    f"{READINGS}, {CLEANED}",
    union(
        f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS "rows" FROM cleaned
 WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        for c in ("season", "station_id", "station_type")
    ),
)
_encoded_numbers = [
    f"""SELECT reading_id, cast({i} as int) AS place, {r('(v - avg(v) OVER ()) / stddev_pop(v) OVER ()', 6)} AS value
 FROM (SELECT reading_id, coalesce(cast({c} as double), (SELECT cast(median({c}) as double) FROM readings)) AS v FROM readings)"""
    for i, c in enumerate(("pm25", "benzene", "visibility_km", "wind_speed_ms"))
]
_encoded_categories = [
    f"""SELECT f.reading_id, cast({start} + k.place as int) AS place, case when f.v = k.v then 1e0 else 0e0 end AS value
 FROM filled_{c} f, (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place FROM (SELECT DISTINCT v FROM filled_{c})) k"""
    for c, start in (("season", "4"), ("station_type", "4 + (SELECT count(DISTINCT v) FROM filled_season)"))
]
_filled_categories = ", ".join(
    f"""filled_{c} AS (SELECT reading_id, coalesce({c}, (SELECT {c} FROM readings WHERE {c} IS NOT NULL GROUP BY {c}
  ORDER BY count(*) DESC, {c} LIMIT 1)) AS v FROM readings)"""
    for c in ("season", "station_type")
)
ORACLES["encoded_vectors"] = over(
    f"{READINGS}, {_filled_categories}", union([*_encoded_numbers, *_encoded_categories])
)

# ---- exploration ----

ORACLES["label_prevalence"] = over(
    READINGS,
    union(
        f"SELECT '{c}' AS label, {r(f'avg({c})', 6)} AS positive_rate FROM readings" for c in LABELS
    ),
)
ORACLES["label_cardinality"] = over(
    f"{READINGS}, active AS (SELECT {' + '.join(LABELS)} AS active_labels FROM readings),"
    " total AS (SELECT count(*) AS n, sum(active_labels) AS s FROM active)",
    f"""SELECT active_labels, count(*) AS "rows", {r('cast(count(*) as double) / any_value(n) * 100', 2)} AS pct,
 {r('cast(any_value(s) as double) / any_value(n)', 2)} AS mean_labels FROM active, total GROUP BY 1""",
)
_box = union(
    f"SELECT {title('station_type')} AS station_type, '{p}' AS pollutant, {p} AS v FROM readings"
    f" WHERE {p} IS NOT NULL"
    for p in POLLUTANTS
)
ORACLES["pollutant_quartiles"] = over(
    f"""{READINGS}, long AS ({_box}), q AS (SELECT station_type, pollutant, quantile_cont(v, 0.25) AS q25,
  quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM long GROUP BY 1, 2),
 marked AS (SELECT *, v BETWEEN q25 - 1.5e0 * (q75 - q25) AND q75 + 1.5e0 * (q75 - q25) AS inside
  FROM long JOIN q USING (station_type, pollutant))""",
    f"""SELECT station_type, pollutant, {r('q25', 6)} AS q25, {r('q50', 6)} AS q50, {r('q75', 6)} AS q75,
 count(*) AS n, min(v) AS lowest, max(v) AS highest, min(v) FILTER (WHERE inside) AS whisker_low,
 max(v) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers
 FROM marked GROUP BY station_type, pollutant, marked.q25, marked.q50, marked.q75""",
)
_hours = ", ".join(
    f"{r(f'avg(pm25) FILTER (WHERE hour = {h})', 6)} AS h{h:02d}" for h in range(24)
)
ORACLES["season_hour_pivot"] = over(
    f"{READINGS}, titled AS (SELECT {title('season')} AS season, hour, pm25 FROM readings)",
    f"""SELECT season, {_hours} FROM titled WHERE season IN ('Winter', 'Spring', 'Summer', 'Fall')
 GROUP BY season""",
)
ORACLES["inversion_histogram"] = over(
    READINGS,
    f"""SELECT temp_inversion, cast(floor(pm25 / 5) * 5 as int) AS bin_start, count(*) AS "rows",
 {r('cast(count(*) as double) / sum(count(*)) OVER (PARTITION BY temp_inversion)', 6)} AS share,
 count(*) FILTER (WHERE pm25 > 35.4e0) AS unhealthy_rows
FROM readings GROUP BY 1, 2""",
)
ORACLES["inversion_summary"] = over(
    READINGS,
    f"""SELECT temp_inversion, count(*) AS "rows", {r(f"avg({flag('pm25 > 35.4e0')})", 4)} AS unhealthy_share
 FROM readings GROUP BY 1""",
)

# ---- streams ----

ORACLES["stream_ingest"] = over(
    f"""{READINGS}, sent AS (SELECT reading_id AS source, {named(_sent)} FROM readings
  WHERE {_n} % 13 <> 0),
 {with_scores('sent')}""",
    """SELECT reading_id, source, station_id, total_alerts, max_risk_prob, dominant_risk, alert_signature
 FROM scored""",
)
ORACLES["stream_hourly"] = over(
    SCORED_RAW,
    f"""SELECT "timestamp" AS window_start, count(*) AS "rows", {r('avg(aqi)', 2)} AS avg_aqi,
 {r('avg(total_alerts)', 2)} AS avg_total_alerts, {r('max(max_risk_prob)', 4)} AS max_risk_prob,
 count(*) FILTER (WHERE total_alerts > 0) AS active_rows FROM scored GROUP BY 1""",
)
ORACLES["stream_first_per_reading"] = over(
    READINGS,
    f"""SELECT DISTINCT cast({_n} as varchar) AS reading_id, "timestamp", station_id FROM readings""",
)


def model_scores(name: str) -> str:
    probs = cols(f"{r(p, 6)} AS {p}" for p in PROBS)
    limits = ("0.5", "0.5", "0.5", "0.5", "0.3")
    alerts = [f"{flag(f'{p} >= {limit}')}" for p, limit in zip(PROBS, limits)]
    dominant = " ".join(f"when {p} = greatest({cols(PROBS)}) then '{p.removeprefix('prob_label_')}'" for p in PROBS)
    return f"""WITH {READINGS},
model AS ({probability_sql(STORED_MODELS[name], "readings")})
SELECT reading_id, {probs}, {cols(f"{a} AS {p.replace('prob_label_', 'alert_')}" for a, p in zip(alerts, PROBS))},
 {" + ".join(alerts)} AS total_alerts, case {dominant} end AS dominant_risk,
 {" || ".join(f"cast({a} as varchar)" for a in alerts)} AS alert_signature, '{name}' AS model_version
FROM model"""


ORACLES["chain_scores"] = model_scores("classifier_chain_lr")
ORACLES["forest_scores"] = model_scores("random_forest")
ORACLES["extra_trees_scores"] = model_scores("extra_trees")
