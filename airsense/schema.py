"""Column contracts of the sensor-reading tables and the fixed domain values."""

from pyspark.sql import types as T

# ---- fixed values: labels, in the order every signature and matrix uses ----
LABELS = (
    "label_respiratory_risk",
    "label_cardiovascular_risk",
    "label_vulnerable_alert",
    "label_outdoor_warning",
    "label_industrial_event",
)
LABEL_TITLES = {
    "label_respiratory_risk": "Respiratory Risk",
    "label_cardiovascular_risk": "Cardiovascular Risk",
    "label_vulnerable_alert": "Vulnerable Alert",
    "label_outdoor_warning": "Outdoor Warning",
    "label_industrial_event": "Industrial Event",
}
# ---- end of fixed values ----

RISKS = tuple(label.removeprefix("label_") for label in LABELS)
PROBS = tuple(f"prob_{label}" for label in LABELS)
ALERTS = tuple(f"alert_{risk}" for risk in RISKS)

_INT, _DOUBLE, _STRING, _TS = T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType()

READING_TYPES: dict[str, T.DataType] = {
    "reading_id": _STRING,
    "timestamp": _TS,
    "year": _INT,
    "month": _INT,
    "hour": _INT,
    "day_of_week": _INT,
    "is_weekend": _INT,
    "is_rush_hour": _INT,
    "season": _STRING,
    "station_id": _STRING,
    "station_type": _STRING,
    "elevation_m": _DOUBLE,
    "near_highway": _INT,
    "near_industry": _INT,
    "temp_c": _DOUBLE,
    "humidity_pct": _DOUBLE,
    "wind_speed_ms": _DOUBLE,
    "wind_dir_deg": _DOUBLE,
    "pressure_hpa": _DOUBLE,
    "precipitation_mm": _DOUBLE,
    "visibility_km": _DOUBLE,
    "temp_inversion": _INT,
    "pm25": _DOUBLE,
    "pm10": _DOUBLE,
    "no2": _DOUBLE,
    "o3": _DOUBLE,
    "so2": _DOUBLE,
    "co": _DOUBLE,
    "benzene": _DOUBLE,
    "aqi": _INT,
    **{label: _INT for label in LABELS},
}
READING_COLUMNS = tuple(READING_TYPES)
READING_SCHEMA = T.StructType([T.StructField(c, t) for c, t in READING_TYPES.items()])
NON_ID_COLUMNS = tuple(c for c in READING_COLUMNS if c != "reading_id")

CALENDAR_COLUMNS = ("year", "month", "hour", "day_of_week", "is_weekend", "is_rush_hour", "season")
LIVE_BASE_COLUMNS = tuple(
    c for c in READING_COLUMNS if c not in CALENDAR_COLUMNS and c not in LABELS
)
# A live payload may leave these out; every other base column must be present.
LIVE_OPTIONAL_COLUMNS = (
    "reading_id", "timestamp", "wind_dir_deg", "pressure_hpa", "visibility_km", "benzene",
)
LIVE_REQUIRED_COLUMNS = tuple(c for c in LIVE_BASE_COLUMNS if c not in LIVE_OPTIONAL_COLUMNS)
LIVE_TEXT_COLUMNS = ("reading_id", "timestamp", "station_id", "station_type")

CATEGORICAL_COLUMNS = ("season", "station_id", "station_type")
IMPUTED_COLUMNS = ("benzene", "visibility_km", "wind_dir_deg", "pressure_hpa")
MISSING_FLAGS = tuple(f"{c}_missing" for c in IMPUTED_COLUMNS)
QUALITY_FLAGS = ("pm10_adjusted_flag", "aqi_gap_flag", "wind_speed_zero_flag", *MISSING_FLAGS)

CIRCULAR_FEATURES = ("hour_sin", "hour_cos", "month_sin", "month_cos", "wind_sin", "wind_cos")
LOGGED_COLUMNS = ("pm25", "pm10", "no2", "so2", "co", "benzene", "aqi")
COMPOSITE_FEATURES = (
    "pm_fine_ratio", "oxidant_load", "combustion_index", "industrial_signature",
    "aqi_excess_150", "aqi_excess_100", *(f"log_{c}" for c in LOGGED_COLUMNS),
)
WEATHER_FEATURES = (
    "dispersion_index", "precipitation_flag", "heavy_rain", "heat_ozone_risk",
    "inversion_severity", "haze_flag", "urban_heat", "industrial_downwind", "urban_rush",
)
RISK_FEATURES = ("pm25_cardio_zone", "multi_label_event", "pollutants_above_who")
ROLLED_COLUMNS = ("pm25", "no2", "aqi")
ROLLING_FEATURES = (
    *(f"{c}_{kind}" for c in ROLLED_COLUMNS for kind in ("roll3_mean", "lag1", "trend")),
    "pm25_rising",
)
ENCODED_THEN_DROPPED = ("wind_dir_deg", "hour", "month")

# Model inputs: every reading column that is neither id, time, label nor replaced by an encoding,
# then the columns cleaning adds, then the engineered ones.
FEATURE_COLUMNS = (
    *(
        c
        for c in READING_COLUMNS
        if c not in ("reading_id", "timestamp", *LABELS, *ENCODED_THEN_DROPPED)
    ),
    *MISSING_FLAGS,
    "pm10_adjusted_flag", "aqi_reference_pm25", "aqi_gap", "aqi_gap_flag", "wind_speed_zero_flag",
    *CIRCULAR_FEATURES,
    *COMPOSITE_FEATURES,
    *WEATHER_FEATURES,
    *RISK_FEATURES,
    *ROLLING_FEATURES,
)

# Columns of the 100-row feature sample export.
SAMPLE_COLUMNS = (
    "reading_id", "timestamp", "station_id", "station_type", "season", "hour",
    "pm25", "pm10", "no2", "o3", "so2", "co", "benzene", "aqi",
    "pm_fine_ratio", "oxidant_load", "dispersion_index",
    "pm25_roll3_mean", "pm25_lag1", "pm25_trend", "pm25_rising",
)

# ---- fixed values: shipped thresholds and training baseline ----
THRESHOLDS = {
    "label_respiratory_risk": 0.5,
    "label_cardiovascular_risk": 0.5,
    "label_vulnerable_alert": 0.5,
    "label_outdoor_warning": 0.5,
    "label_industrial_event": 0.3,
}
BASELINE_RATES = {
    "label_respiratory_risk": 0.2877,
    "label_cardiovascular_risk": 0.1829,
    "label_vulnerable_alert": 0.7336,
    "label_outdoor_warning": 0.3129,
    "label_industrial_event": 0.3549,
}
# Symmetric; rows and columns in label order, the diagonal equals the rates.
BASELINE_COOCCURRENCE = (
    (0.2877, 0.1291, 0.2739, 0.2601, 0.1337),
    (0.1291, 0.1829, 0.1673, 0.1361, 0.0893),
    (0.2739, 0.1673, 0.7336, 0.2981, 0.2883),
    (0.2601, 0.1361, 0.2981, 0.3129, 0.1410),
    (0.1337, 0.0893, 0.2883, 0.1410, 0.3549),
)
BASELINE_MODEL = {
    "selected_model": "random_forest",
    "hamming_loss": 0.0358,
    "f1_macro": 0.9406409861019375,
    "exact_match": 0.834,
}
# ---- end of fixed values ----
