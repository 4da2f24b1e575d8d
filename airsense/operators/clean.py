"""Cleaning, in its fixed order: dedupe, categories, missing flags, quality flags, repair, fill."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsense.functions.domain import aqi_from_pm25, clean_season, clean_station_type
from airsense.functions.numeric import flag, rnd
from airsense.operators.quantiles import exact_quantiles
from airsense.schema import IMPUTED_COLUMNS
from airsense.sources.stored import Lookup, as_lookup, store

AQI_GAP_LIMIT = 30
GROUP_MEDIANS = {"benzene": "station_type", "pressure_hpa": "month"}
CONSTANT_FILLS = {"visibility_km": 1.0, "wind_dir_deg": 180.0}
EVERY_GROUP = "\x00every group"


def drop_sensor_duplicates(df: DataFrame) -> DataFrame:
    """Of rows equal on all but ``reading_id`` keep the one with the smallest id.

    A grouping, not a window: copies collapse on the map side, so a group holding a large share of
    all rows never reaches one task. The leading hash makes the sort compare eight bytes instead
    of the whole row; equality is still decided on every column.
    """
    keys = [c for c in df.columns if c != "reading_id"]
    return (
        df.groupBy(F.xxhash64(*keys).alias("row_hash"), *keys)
        .agg(F.min("reading_id").alias("reading_id"))
        .select(*df.columns)
    )


def clean_categories(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "season": clean_season(F.col("season")),
            "station_type": clean_station_type(F.col("station_type")),
        }
    )


def add_missing_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f"{c}_missing": F.col(c).isNull().cast("int") for c in IMPUTED_COLUMNS}
    )


def add_sensor_quality_flags(df: DataFrame) -> DataFrame:
    reference = aqi_from_pm25(F.col("pm25"))
    return (
        df.withColumns(
            {
                "pm10_adjusted_flag": flag(F.col("pm10") < F.col("pm25")),
                "aqi_reference_pm25": reference,
            }
        )
        .withColumn("aqi_gap", rnd((F.col("aqi") - F.col("aqi_reference_pm25")).cast("double"), 2))
        .withColumns(
            {
                "aqi_gap_flag": flag(F.abs("aqi_gap") > AQI_GAP_LIMIT),
                "wind_speed_zero_flag": flag(F.col("wind_speed_ms") == 0),
            }
        )
    )


def repair_physical_values(df: DataFrame) -> DataFrame:
    """Coarse particles include fine ones: a smaller PM10 is replaced by 1.5 times PM2.5."""
    return df.withColumn(
        "pm10",
        F.when(F.col("pm10") < F.col("pm25"), rnd(F.col("pm25") * 1.5, 2)).otherwise(F.col("pm10")),
    )


def clean_rows(df: DataFrame) -> DataFrame:
    """The row-wise steps; one projection after Catalyst collapses them."""
    return (
        df.transform(clean_categories)
        .transform(add_missing_flags)
        .transform(add_sensor_quality_flags)
        .transform(repair_physical_values)
    )


@dataclass(frozen=True)
class FillValues:
    """Medians learned from a table: ``column_name, group_value, median``, and overall ones."""

    medians: Lookup
    overall: dict[str, float | None]


def fit_fill_values(df: DataFrame) -> FillValues:
    """Exact medians per group and overall, over the value and group columns of ``df`` only."""
    everything = F.lit(EVERY_GROUP)
    entries = [
        F.struct(F.concat(F.lit(f"{column}:"), name).alias("key"), F.col(column).alias("value"))
        for column, group in GROUP_MEDIANS.items()
        for name in (F.col(group).cast("string"), everything)
    ]
    long = df.select(F.inline(F.array(*entries))).where("value is not null")
    medians = exact_quantiles(long, ("key",), ["value"], (0.5,))
    lookup = as_lookup(medians.select("key", F.col("quantile").alias("median")), "medians")
    overall_keys = {f"{column}:{EVERY_GROUP}": column for column in GROUP_MEDIANS}
    found = lookup.rows or lookup.table.where(F.col("key").isin(*overall_keys)).collect()
    found = [r for r in found if r["key"] in overall_keys]
    return FillValues(lookup, {overall_keys[r["key"]]: r["median"] for r in found})


def impute(df: DataFrame, fills: FillValues) -> DataFrame:
    """Group median, then overall median, then the fixed fills; columns keep their order."""
    filled, values = df, {}
    for column, group in GROUP_MEDIANS.items():
        key = F.concat(F.lit(f"{column}:"), F.col(group).cast("string"))
        medians = fills.medians.table.where(F.col("key").startswith(f"{column}:")).select(
            F.col("key").alias(f"{column}_key"), F.col("median").alias(f"{column}_median")
        )
        side = F.broadcast(medians) if fills.medians.small else medians
        filled = filled.join(side, key == F.col(f"{column}_key"), "left")
        overall = F.lit(fills.overall.get(column)).cast("double")
        values[column] = F.coalesce(F.col(column), F.col(f"{column}_median"), overall)
    values |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in CONSTANT_FILLS.items()}
    return filled.withColumns(values).select(*df.columns)


def preprocess(df: DataFrame, fills: FillValues | None = None) -> DataFrame:
    """The whole cleaning chain.

    With ``fills`` learned earlier the result is one lazy plan with a single shuffle. Without, the
    medians come from the table itself: the deduplicated rows are stored once, the medians read
    two columns of that table, and the result is a narrow projection over it.
    """
    cleaned = clean_rows(drop_sensor_duplicates(df))
    if fills is None:
        cleaned = store(cleaned, "cleaned")
        fills = fit_fill_values(cleaned)
    return impute(cleaned, fills)
