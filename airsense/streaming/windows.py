"""Event-time forms of the timeline and of the duplicate filter."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsense.functions.numeric import rnd


def hourly_timeline(
    scored: DataFrame, lateness: str | None = None, width: str = "1 hour"
) -> DataFrame:
    """Timeline figures per tumbling window.

    Without ``lateness`` no row is ever too late: state is one row per window, and a stream in
    update mode gives out every window that changed. With it, a window is final once the watermark
    passes it, and later rows are left out.
    """
    rows = scored.withWatermark("timestamp", lateness) if lateness else scored
    return (
        rows.groupBy(F.window("timestamp", width))
        .agg(
            F.count("*").alias("rows"),
            rnd(F.avg("aqi"), 2).alias("avg_aqi"),
            rnd(F.avg("total_alerts"), 2).alias("avg_total_alerts"),
            rnd(F.max("max_risk_prob"), 4).alias("max_risk_prob"),
            F.count_if(F.col("total_alerts") > 0).alias("active_rows"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            "rows", "avg_aqi", "avg_total_alerts", "max_risk_prob", "active_rows",
        )
    )


def first_per_reading(readings: DataFrame, lateness: str | None = None) -> DataFrame:
    """Of each ``reading_id`` the earliest row, ties settled by the other columns, null times last.

    Without ``lateness`` no row is ever too late, and the result depends on neither files nor
    batches: over a table a keyed aggregate, over a stream a state of one row per reading. With it,
    replays within that bound of a stream are dropped from bounded state, and rows older than the
    watermark are left out.
    """
    if lateness:
        return readings.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(
            ["reading_id"]
        )
    others = [c for c in readings.columns if c not in ("reading_id", "timestamp")]
    first = F.min(F.struct(F.col("timestamp").isNull().alias("no_time"), "timestamp", *others))
    return (
        readings.groupBy("reading_id").agg(first.alias("row"))
        .select(*(c if c == "reading_id" else F.col("row")[c].alias(c) for c in readings.columns))
    )
