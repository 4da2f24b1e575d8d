"""Data-quality checks on raw readings."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsense.functions.domain import SEASONS, aqi_from_pm25
from airsense.functions.numeric import flag, rnd
from airsense.operators.quantiles import exact_quantiles
from airsense.sources import stored

# ---- fixed values ----
EXTREME_GAS = 200
AQI_GAP_LIMIT = 30
# ---- end of fixed values ----

#: What cleaning does to a column, for readers.
CLEANING_RULES = {
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

PROBLEM_COLUMNS = (
    "reading_id", "timestamp", "station_id", "station_type", "season",
    "pm25", "pm10", "no2", "o3", "aqi", "wind_speed_ms",
)
QUARTILES = (0.25, 0.5, 0.75)


def physical_rules() -> dict[str, Column]:
    """Named predicates; a row where one is unknown does not break it."""
    return {
        "pm10_less_than_pm25": F.col("pm10") < F.col("pm25"),
        "aqi_discrepancy_over_30": F.abs(F.col("aqi") - aqi_from_pm25(F.col("pm25")))
        > AQI_GAP_LIMIT,
        "zero_wind_speed": F.col("wind_speed_ms") == 0,
        "extreme_o3_no2": (F.col("o3") > EXTREME_GAS) & (F.col("no2") > EXTREME_GAS),
    }


def rule_violations() -> dict[str, Column]:
    """What the cleaning rules act on, per column."""
    rules, missing = physical_rules(), lambda name: F.col(name).isNull()
    cleaned_type = F.initcap(F.btrim("station_type"))
    return {
        "season": ~F.coalesce(F.col("season").isin(*SEASONS.values()), F.lit(False)),
        "station_type": ~F.col("station_type").eqNullSafe(cleaned_type),
        "benzene": missing("benzene"),
        "visibility_km": missing("visibility_km"),
        "wind_dir_deg": missing("wind_dir_deg"),
        "pressure_hpa": missing("pressure_hpa"),
        "pm10": rules["pm10_less_than_pm25"],
        "aqi": rules["aqi_discrepancy_over_30"],
        "wind_speed_ms": rules["zero_wind_speed"],
    }


def _long(one_row: DataFrame, entries: Sequence[Sequence[tuple[str, Column]]]) -> DataFrame:
    """Turn one aggregated row into one row per entry."""
    structs = [F.struct(*[c.alias(name) for name, c in entry]) for entry in entries]
    return one_row.select(F.inline(F.array(*structs)))


def content_digest(df: DataFrame) -> Column:
    """SHA-256 of all columns but the id: equal for rows that grouping would put together."""

    def plain(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return F.unix_micros(column).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return (column + F.lit(0.0)).alias(field.name)  # one zero, not two
        return column

    content = [plain(f) for f in df.schema.fields if f.name != "reading_id"]
    return F.unhex(F.sha2(F.to_json(F.struct(*content)), 256))


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Row count, full-row duplicates and duplicates ignoring the id, in one chain.

    Rows travel as a digest and an id. Exact copies collapse before the first shuffle and copies
    under other ids before the second, so neither kind of hot group travels as rows.
    """
    keyed = df.select(content_digest(df).alias("digest"), "reading_id")
    rows = keyed.groupBy("digest", "reading_id").agg(F.count("*").alias("copies"))
    groups = rows.groupBy("digest").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("distinct_rows")
    )
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.coalesce(F.sum(F.col("copies") - F.col("distinct_rows")), F.lit(0)).alias(
            "duplicate_rows"
        ),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_excluding_reading_id"),
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """Null count and rate of every column in one pass."""
    counted = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns],
    )
    rows = F.nullif(F.col("rows"), F.lit(0))
    return _long(
        counted,
        [
            [
                ("column_name", F.lit(c)),
                ("data_type", F.lit(df.schema[c].dataType.simpleString())),
                ("non_null", F.col("rows") - F.col(f"n_{c}")),
                ("missing", F.col(f"n_{c}")),
                ("missing_rate", rnd(F.col(f"n_{c}") / rows, 4)),
                ("missing_pct", rnd(F.col(f"n_{c}") / rows * 100, 4)),
            ]
            for c in df.columns
        ],
    )


def physical_checks(df: DataFrame) -> DataFrame:
    rules = physical_rules()
    counted = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return _long(counted, [[("check_name", F.lit(n)), ("rows", F.col(n))] for n in rules])


def rule_catalogue(df: DataFrame) -> DataFrame:
    """The declared cleaning rules with the number of rows each one acts on."""
    violations = rule_violations()
    counted = df.agg(*[F.count_if(v).alias(name) for name, v in violations.items()])
    return _long(
        counted,
        [
            [("column_name", F.lit(n)), ("rule", F.lit(text)), ("rows", F.col(n))]
            for n, text in CLEANING_RULES.items()
        ],
    )


def problem_rows(df: DataFrame) -> DataFrame:
    broken = reduce(lambda a, b: a | b, [flag(rule) == 1 for rule in physical_rules().values()])
    return df.where(broken).select(*PROBLEM_COLUMNS)


#: Bits of one bitmap, and bitmaps of the filter at most (4 kB each, 32 MB in all).
BITMAP_BITS, MOST_BITMAPS = 32768, 8192
#: Bits of the filter per digest that it holds.
BITS_PER_DIGEST = 16


def maybe_in(df: DataFrame, digests: DataFrame, count: int) -> DataFrame:
    """The rows of ``df`` whose ``digest`` may be one of ``digests``; all that are, few others.

    A hash of a digest is a bit of a broadcast bitmap, which is bounded in size whatever ``count``
    is: beyond that more rows pass, never fewer."""
    bitmaps = min(MOST_BITMAPS, -(-count * BITS_PER_DIGEST // BITMAP_BITS)) or 1
    place = F.pmod(F.xxhash64("digest"), F.lit(bitmaps * BITMAP_BITS)) + 1
    seen = digests.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bitmap_no")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(digest_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = df.withColumns({"bitmap_no": F.bitmap_bucket_number(place), "digest_bit": at}).join(F.broadcast(seen), "bitmap_no")
    return marked.where(F.bit_get(byte, (F.col("digest_bit") % 8).cast("int")) == 1).drop("bitmap_no", "digest_bit", "bits")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Every member of each group equal on all but the id, with the size of its group.

    Digests are counted first. If few of them occur again, they are broadcast with their counts and
    no row is shuffled. Else a bitmap of them lets the rows of single digests go before the join, in
    which a skew join can split a group that holds a large share of the rest, since it meets one
    row on the other side.
    """
    hashed = df.withColumn("digest", content_digest(df))
    sizes = hashed.groupBy("digest").agg(F.count("*").alias("group_size")).where("group_size > 1")
    again = stored.store(sizes, "duplicate-sizes")
    groups = again.count()
    if groups <= stored.SMALL_TABLE_ROWS:
        return hashed.join(F.broadcast(again), "digest").select(*df.columns, "group_size")
    return maybe_in(hashed, again, groups).join(again, "digest").select(*df.columns, "group_size")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of the numeric columns."""
    columns = list(columns or numeric_columns(df))
    names = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    value = {c: F.col(c).cast("double") for c in columns}
    counted = df.agg(*[f(value[c]).alias(f"{name}_{c}") for c in columns for name, f in names.items()])
    basics = _long(
        counted,
        [[("column_name", F.lit(c)), *[(n, F.col(f"{n}_{c}")) for n in names]] for c in columns],
    ).where("count > 0")
    quartiles = (
        exact_quantiles(df, (), columns, QUARTILES)
        .groupBy("column_name")
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"q{int(p * 100)}")
                for p in QUARTILES
            ]
        )
    )
    return basics.join(quartiles, "column_name", "left")


def null_masks(df: DataFrame) -> DataFrame:
    """Missingness pattern: rows per 0/1 mask over all columns."""
    mask = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in df.columns])
    return df.groupBy(mask.alias("null_mask")).agg(F.count("*").alias("rows"))


def quality_summary(df: DataFrame) -> DataFrame:
    """The six-line text summary."""

    def lines(one_row: DataFrame, first: int, texts: dict[str, Column]) -> DataFrame:
        return _long(
            one_row,
            [
                [
                    ("line_no", F.lit(number)),
                    ("line", F.concat(F.lit(f"{text}: "), value.cast("string"))),
                ]
                for number, (text, value) in enumerate(texts.items(), first)
            ],
        )

    rules = physical_rules()
    broken = {
        "PM10 < PM2.5 rows": "pm10_less_than_pm25",
        "AQI mismatch rows": "aqi_discrepancy_over_30",
        "Wind speed = 0.0 rows": "zero_wind_speed",
    }
    counts = lines(
        duplicate_counts(df),
        1,
        {
            "Rows": F.format_number("total_rows", 0),
            "Columns": F.col("total_columns"),
            "Duplicate rows excluding reading_id": F.col("duplicates_excluding_reading_id"),
        },
    )
    checks = df.agg(*[F.count_if(rules[name]).alias(name) for name in broken.values()])
    return counts.unionByName(
        lines(checks, 4, {text: F.col(name) for text, name in broken.items()})
    )


def validation_summary(df: DataFrame) -> DataFrame:
    """Counts, missing values and rates, and physical checks as ``section, metric, value``.

    Two chains: the duplicate grouping, and one pass for everything that needs no grouping.
    """

    def entry(section: str, metric: str, value: Column) -> list[tuple[str, Column]]:
        return [
            ("section", F.lit(section)),
            ("metric", F.lit(metric)),
            ("value", value.cast("double")),
        ]

    counts = duplicate_counts(df)
    overall = _long(counts, [entry("overview", name, F.col(name)) for name in counts.columns])
    rules = physical_rules()
    counted = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns],
        *[F.count_if(rule).alias(name) for name, rule in rules.items()],
    )
    rows = F.nullif(F.col("rows"), F.lit(0))
    entries = [entry("missing_values", c, F.col(f"n_{c}")) for c in df.columns]
    entries += [entry("missing_rates", c, rnd(F.col(f"n_{c}") / rows, 4)) for c in df.columns]
    entries += [entry("physical_checks", name, F.col(name)) for name in rules]
    return overall.unionByName(_long(counted, entries))
