"""Exploratory aggregates."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airsense.functions.domain import BLANKS, title_case
from airsense.functions.numeric import rnd, total
from airsense.operators.quantiles import exact_quantiles
from airsense.schema import LABELS
from airsense.sources.stored import as_lookup

# ---- fixed values ----
POLLUTANTS = ("pm25", "no2", "o3", "so2", "co", "benzene")
WHISKER_REACH = 1.5
SEASON_ORDER = ("Winter", "Spring", "Summer", "Fall")
UNHEALTHY_PM25 = 35.4
# ---- end of fixed values ----


def title_categories(df: DataFrame) -> DataFrame:
    """The looser clean-up used for exploration: trim and title-case only."""
    return df.withColumns(
        {c: title_case(F.btrim(c, F.lit(BLANKS))) for c in ("season", "station_type")}
    )


def label_prevalence(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    rates = df.agg(*[F.avg(label).alias(label) for label in labels])
    entries = [
        F.struct(F.lit(label).alias("label"), F.col(label).alias("positive_rate"))
        for label in labels
    ]
    return rates.select(F.inline(F.array(*entries))).orderBy(F.desc("positive_rate"), "label")


def label_cardinality(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Rows per number of active labels, with percentage; the mean repeats on every row."""
    active = total(F.coalesce(F.col(label), F.lit(0)) for label in labels)
    sizes = range(len(labels) + 1)
    counted = df.agg(
        F.count("*").alias("all_rows"),
        F.sum(active).alias("all_labels"),
        *[F.count_if(active == k).alias(f"n_{k}") for k in sizes],
    )
    entries = [
        F.struct(
            F.lit(k).alias("active_labels"),
            F.col(f"n_{k}").alias("rows"),
            rnd(F.col(f"n_{k}") / F.col("all_rows") * 100, 2).alias("pct"),
            rnd(F.col("all_labels") / F.col("all_rows"), 2).alias("mean_labels"),
        )
        for k in sizes
    ]
    return counted.where("all_rows > 0").select(F.inline(F.array(*entries))).where("rows > 0")


def pollutant_quartiles(df: DataFrame, pollutants: Sequence[str] = POLLUTANTS) -> DataFrame:
    """Box-plot statistics per station type and pollutant.

    Quartiles are exact; whiskers are the outermost values within 1.5 interquartile ranges, and
    everything beyond them is counted as an outlier.
    """
    kept = df.where("station_type is not null").select("station_type", *pollutants)
    quartiles = as_lookup(
        exact_quantiles(kept, ("station_type",), pollutants, (0.25, 0.5, 0.75))
        .groupBy("station_type", "column_name")
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
                for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
            ]
        )
        .withColumnRenamed("column_name", "pollutant"),
        "pollutant-quartiles",
    )
    long = kept.unpivot(["station_type"], list(pollutants), "pollutant", "value").where(
        "value is not null"
    )
    reach = WHISKER_REACH * (F.col("q75") - F.col("q25"))
    inside = F.col("value").between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        long.join(quartiles.side(), ["station_type", "pollutant"])
        .groupBy("station_type", "pollutant", "q25", "q50", "q75")
        .agg(
            F.count("*").alias("n"),
            F.min("value").alias("lowest"),
            F.max("value").alias("highest"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def season_hour_pivot(df: DataFrame) -> DataFrame:
    """Mean PM2.5 by season (rows, fixed order) and hour (24 columns)."""
    order = F.array_position(F.array(*[F.lit(s) for s in SEASON_ORDER]), F.col("season"))
    return (
        df.where(F.col("season").isin(*SEASON_ORDER))
        .groupBy("season")
        .pivot("hour", list(range(24)))
        .agg(F.avg("pm25"))
        .select("season", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])
        .orderBy(order)
    )


def inversion_histogram(df: DataFrame, width: int = 5) -> DataFrame:
    """PM2.5 histogram per inversion flag, with the share of the whole class: shares of a class add
    up to 1. A reading without PM2.5 falls into the bin null."""
    start = (F.floor(F.col("pm25") / width) * width).cast("int")
    bins = df.groupBy("temp_inversion", start.alias("bin_start")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("pm25") > UNHEALTHY_PM25).alias("unhealthy_rows"),
    )
    # a window over the few bins of a class, not over its rows
    whole = F.sum("rows").over(Window.partitionBy("temp_inversion"))
    return bins.select(
        "temp_inversion", "bin_start", "rows", rnd(F.col("rows") / whole, 6).alias("share"), "unhealthy_rows"
    )


def inversion_summary(df: DataFrame) -> DataFrame:
    """Share of readings above the unhealthy PM2.5 level, per inversion flag."""
    return (
        df.where(F.col("temp_inversion").isin(0, 1) & F.col("pm25").isNotNull())
        .groupBy("temp_inversion")
        .agg(
            F.count("*").alias("rows"),
            rnd(F.avg((F.col("pm25") > UNHEALTHY_PM25).cast("int")), 4).alias("unhealthy_share"),
        )
    )
