"""Readings and scored readings derived from the ``events`` table.

Every expression is integer or exactly rounded arithmetic, so another SQL engine gives the same
cells. About one reading in 350 arrives twice under another id; categories are dirty on purpose.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsense.operators.scoring import add_alerts, add_score_summary
from airsense.schema import READING_COLUMNS, THRESHOLDS

DIGITS = "case when event_id < 10000000 then lpad(cast(event_id as string), 7, '0') else cast(event_id as string) end"

# Every column but the id; written so that Spark SQL and ANSI SQL engines read it alike.
# ``{weekday}`` is Monday = 0.
READING_SQL = {
    "timestamp": "date_trunc('hour', ts)",
    "year": "cast(year(ts) as int)",
    "month": "cast(month(ts) + (event_id % 12) as int)"
    " - 12 * cast(floor((month(ts) + (event_id % 12) - 1) / 12) as int)",
    "hour": "cast(hour(ts) as int)",
    "day_of_week": "cast({weekday} as int)",
    "is_weekend": "case when {weekday} >= 5 then 1 else 0 end",
    "is_rush_hour": "case when hour(ts) in (7, 8, 9, 16, 17, 18, 19) then 1 else 0 end",
    "season": "case cast(event_id % 8 as int) when 0 then 'Winter' when 1 then ' winter '"
    " when 2 then 'SPRING' when 3 then 'summer' when 4 then 'Autumn' when 5 then 'fall'"
    " when 6 then 'monsoon' else null end",
    "station_id": "concat('STN_', cast(user_id % 6 as string))",
    "station_type": "case cast(user_id % 6 as int) when 0 then 'urban' when 1 then ' Urban '"
    " when 2 then 'SUBURBAN' when 3 then 'Suburban' when 4 then 'industrial' else 'Rural' end",
    "elevation_m": "cast(10 + (user_id % 6) * 50 as double)",
    "near_highway": "case when user_id % 6 in (0, 1, 4) then 1 else 0 end",
    "near_industry": "case when user_id % 6 in (2, 4) then 1 else 0 end",
    "temp_c": "(event_id * 17 % 400) / 10 - 5",
    "humidity_pct": "30 + (event_id * 19 % 650) / 10",
    "wind_speed_ms": "case when event_id % 77 = 0 then cast(0 as double)"
    " else (event_id * 23 % 150) / 10 end",
    "wind_dir_deg": "case when event_id % 33 = 0 then null else (event_id * 29 % 3600) / 10 end",
    "pressure_hpa": "case when event_id % 50 = 0 then null"
    " else 990 + (event_id * 31 % 400) / 10 end",
    "precipitation_mm": "case when event_id % 5 = 0 then (event_id * 3 % 120) / 10"
    " else cast(0 as double) end",
    "visibility_km": "case when event_id % 40 = 0 then null"
    " else (5 + event_id * 41 % 300) / 10 end",
    "temp_inversion": "case when event_id % 7 = 0 then 1 else 0 end",
    "pm25": "floor(value * 10) / 10",
    "pm10": "case when event_id % 24 = 0 then floor(value * 8) / 10"
    " else floor(value * 15) / 10 end",
    "no2": "(event_id * 53 % 2300) / 10",
    "o3": "(event_id * 37 % 2500) / 10",
    "so2": "(event_id * 13 % 900) / 10",
    "co": "(event_id * 7 % 500) / 100",
    "benzene": "case when event_id % 25 = 0 then null else (event_id * 11 % 1000) / 100 end",
    "aqi": "cast(least(floor(value * 1.6e0), 500) as int)",
    "label_respiratory_risk": "case when floor(value * 10) / 10 > 55.4e0 then 1 else 0 end",
    "label_cardiovascular_risk": "case when value > 75e0 and event_id % 3 <> 0"
    " then 1 else 0 end",
    "label_vulnerable_alert": "case when value > 12e0 then 1 else 0 end",
    "label_outdoor_warning": "case when value > 45e0 or event_id % 17 = 0 then 1 else 0 end",
    "label_industrial_event": "case when user_id % 6 = 4 or event_id % 11 = 0"
    " then 1 else 0 end",
}

PROB_SQL = {
    "label_respiratory_risk": "pm25 / (pm25 + 40e0)",
    "label_cardiovascular_risk": "pm25 / (pm25 + 60e0)",
    "label_vulnerable_alert": "pm25 / (pm25 + 15e0)",
    "label_outdoor_warning": "aqi / (aqi + 70e0)",
    "label_industrial_event": "so2 / (so2 + 30e0)",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def readings_from_events(source: DataFrame) -> DataFrame:
    """Raw readings of an ``events`` table or stream, in contract order."""
    prefixes = F.expr("case when event_id % 350 = 0 then array('RDG', 'DUP') else array('RDG') end")
    return source.select("*", F.explode(prefixes).alias("prefix")).select(
        F.concat("prefix", F.expr(DIGITS)).alias("reading_id"),
        *[F.expr(sql.format(weekday="weekday(ts)")).alias(name) for name, sql in READING_SQL.items()],
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp")).select(*READING_COLUMNS)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(events(spark, sf_dir))


def add_fixture_probabilities(df: DataFrame) -> DataFrame:
    """Deterministic stand-in for a trained model: a ratio of two sensor values per label."""
    return df.withColumns({f"prob_{label}": F.expr(sql) for label, sql in PROB_SQL.items()})


def add_fixture_scores(df: DataFrame) -> DataFrame:
    """Probabilities, alerts and summary, scored one hour after each reading."""
    return add_score_summary(
        add_alerts(add_fixture_probabilities(df), THRESHOLDS),
        scored_at=F.col("timestamp") + F.expr("interval 1 hour"),
        model_version="fixture",
    )

