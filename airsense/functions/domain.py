"""Column expressions with sensor-domain meaning."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from airsense.functions.numeric import flag

# ---- fixed values ----
# PM2.5 concentration range -> index range; both ends belong to the segment.
AQI_SEGMENTS = (
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 350.4, 301, 400),
    (350.5, 500.4, 401, 500),
)
AQI_CEILING = 500
SEASONS = {
    "winter": "Winter",
    "spring": "Spring",
    "summer": "Summer",
    "fall": "Fall",
    "autumn": "Fall",
}
WHO_LIMITS = {"pm25": 15.0, "pm10": 45.0, "no2": 40.0, "o3": 100.0, "so2": 40.0}
RUSH_HOURS = (7, 8, 9, 16, 17, 18, 19)
RUSH_HOURS_ON_REQUEST = (7, 8, 9, 17, 18, 19)
# ---- end of fixed values ----

UNKNOWN = "Unknown"
BLANKS = " \t\n\r"


def aqi_from_pm25(pm25: Column) -> Column:
    """Index implied by PM2.5; values between two segments, below zero or unknown give 0."""
    value = F.coalesce(F.nanvl(pm25, F.lit(0.0)), F.lit(0.0))
    index = F.when(value > AQI_SEGMENTS[-1][1], F.lit(float(AQI_CEILING)))
    for low, high, index_low, index_high in AQI_SEGMENTS:
        slope = (index_high - index_low) / (high - low)
        index = index.when(
            value.between(low, high),
            F.lit(slope) * (value - F.lit(low)) + F.lit(float(index_low)),
        )
    return F.rint(index.otherwise(F.lit(0.0))).cast("int")


def clean_season(season: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SEASONS.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(F.btrim(season, F.lit(BLANKS)))), F.lit(UNKNOWN))


def title_case(text: Column) -> Column:
    """Capitalise every run of letters; ``initcap`` alone only sees blanks as breaks."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    return F.when(
        text.rlike(r"[^\p{L} ]"), F.array_join(F.transform(runs, F.initcap), "")
    ).otherwise(F.initcap(text))


def clean_station_type(station_type: Column) -> Column:
    return F.coalesce(title_case(F.btrim(station_type, F.lit(BLANKS))), F.lit(UNKNOWN))


def season_of_month(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), F.lit("Winter"))
        .when(month.isin(3, 4, 5), F.lit("Spring"))
        .when(month.isin(6, 7, 8), F.lit("Summer"))
        .otherwise(F.lit("Fall"))
    )


def calendar(timestamp: Column, rush_hours=RUSH_HOURS) -> dict[str, Column]:
    """Calendar columns of a timestamp; weeks start on Monday = 0."""
    hour, weekday, month = F.hour(timestamp), F.weekday(timestamp), F.month(timestamp)
    return {
        "year": F.year(timestamp),
        "month": month,
        "hour": hour,
        "day_of_week": weekday,
        "is_weekend": flag(weekday >= 5),
        "is_rush_hour": flag(hour.isin(*rush_hours)),
        "season": season_of_month(month),
    }


def risk_title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
