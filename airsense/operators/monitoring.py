"""Monitoring aggregates over scored readings."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsense.functions.domain import risk_title
from airsense.functions.numeric import flag, rnd, total
from airsense.schema import (
    ALERTS,
    BASELINE_COOCCURRENCE,
    BASELINE_MODEL,
    BASELINE_RATES,
    LABEL_TITLES,
    LABELS,
    QUALITY_FLAGS,
)
from airsense.sources.stored import as_lookup, store

# ---- fixed values ----
STATION_HIGH_RISK = 0.8
HISTORY_HIGH_RISK = 0.7
STATIONS_SHOWN = 6
# ---- end of fixed values ----

#: What the dashboard reads of a scored row, and the field that names a row of a section.
SNAPSHOT_COLUMNS = (
    "reading_id", "station_id", "station_type", "timestamp", "aqi", *ALERTS, "total_alerts", "max_risk_prob",
    "dominant_risk", "scored_at", *QUALITY_FLAGS,
)
SNAPSHOT_KEYS = {"alerts": "reading_id", "stations": "station_id", "timeline": "timestamp", "labels": "label"}


def _iso(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")


def _or_absent(df: DataFrame, name: str, present: Column, absent: Column) -> Column:
    return present if name in df.columns else absent


def _overview_aggregates(df: DataFrame) -> list[Column]:
    """Headline figures; a missing column gives 0 or null instead of an error."""
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("timestamp")
    zero_rate = F.lit(0.0)
    return [
        F.count(F.lit(1)).alias("readings_scored"),
        _or_absent(df, "station_id", F.count_distinct("station_id"), F.max(zero)).alias(
            "stations_seen"
        ),
        _or_absent(
            df, "total_alerts", F.count_if(F.col("total_alerts") > 0), F.max(zero)
        ).alias("active_alert_rows"),
        _or_absent(df, "timestamp", F.max("timestamp"), F.max(none)).alias("latest_timestamp"),
        _or_absent(df, "scored_at", F.max("scored_at"), F.max(none)).alias("latest_scored_at"),
        _or_absent(df, "aqi", rnd(F.avg("aqi"), 2), F.max(zero_rate)).alias("avg_aqi"),
        _or_absent(df, "total_alerts", rnd(F.avg("total_alerts"), 2), F.max(zero_rate)).alias(
            "avg_total_alerts"
        ),
        _or_absent(df, "max_risk_prob", rnd(F.max("max_risk_prob"), 4), F.max(zero_rate)).alias(
            "max_risk_prob"
        ),
    ]


OVERVIEW_TIMES = ("latest_timestamp", "latest_scored_at")
OVERVIEW_COLUMNS = (
    "readings_scored", "stations_seen", "active_alert_rows", *OVERVIEW_TIMES, "avg_aqi",
    "avg_total_alerts", "max_risk_prob",
)


def build_overview(df: DataFrame) -> DataFrame:
    return df.agg(*_overview_aggregates(df))


def build_recent_alerts(df: DataFrame, limit: int = 8) -> DataFrame:
    """Top-k active rows by risk, index and alert count; the id settles ties."""
    return (
        df.where("total_alerts > 0")
        .orderBy(
            F.desc("max_risk_prob"), F.desc("aqi"), F.desc("total_alerts"), F.asc("reading_id")
        )
        .limit(limit)
        .select(
            "reading_id",
            "station_id",
            "station_type",
            rnd(F.col("aqi").cast("double"), 1).alias("aqi"),
            F.col("total_alerts").cast("int").alias("total_alerts"),
            risk_title(F.col("dominant_risk")).alias("dominant_risk"),
            rnd(F.col("max_risk_prob"), 4).alias("max_risk_prob"),
            _iso(F.col("timestamp")).alias("timestamp"),
            _iso(F.col("scored_at")).alias("scored_at"),
        )
    )


def latest_per_station(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The row with the newest time of each station; the smallest id among equal times.

    The newest times are a fixed-width hash aggregate, so a hot station costs one row per task;
    only rows at those times are then compared by id.
    """
    known = df.where(F.col("station_id").isNotNull() & F.col("timestamp").isNotNull())
    newest = as_lookup(
        known.groupBy("station_id").agg(F.max("timestamp").alias("timestamp")), "newest"
    )
    return (
        known.join(newest.side(), ["station_id", "timestamp"], "left_semi")
        .groupBy("station_id")
        .agg(F.min_by(F.struct(*columns), "reading_id").alias("latest"))
        .select("station_id", "latest.*")
    )


def quality_flag_columns(df: DataFrame) -> list[str]:
    return [c for c in QUALITY_FLAGS if c in df.columns]


def build_station_summary(df: DataFrame) -> DataFrame:
    flags = quality_flag_columns(df)
    present = [
        c
        for c in ("station_type", "aqi", "total_alerts", "max_risk_prob", "dominant_risk", *flags)
        if c in df.columns
    ]
    latest = latest_per_station(df, present)

    def col(name: str, absent) -> Column:
        return F.col(name) if name in present else F.lit(absent)

    return latest.select(
        "station_id",
        col("station_type", None).cast("string").alias("station_type"),
        rnd(col("aqi", None).cast("double"), 1).alias("aqi"),
        col("total_alerts", 0).cast("int").alias("total_alerts"),
        rnd(col("max_risk_prob", 0.0), 4).alias("max_risk_prob"),
        risk_title(col("dominant_risk", "unknown")).alias("dominant_risk"),
        (total(F.col(c) for c in flags) if flags else F.lit(0)).cast("int").alias("quality_flags"),
    ).orderBy(F.desc("max_risk_prob"), F.desc("aqi"), "station_id")


def latest_timestamps(df: DataFrame, points: int) -> DataFrame:
    return (
        df.where("timestamp is not null")
        .select("timestamp")
        .distinct()
        .orderBy(F.desc("timestamp"))
        .limit(points)
    )


def build_timeline(df: DataFrame, points: int = 24) -> DataFrame:
    """Aggregates of the latest ``points`` distinct times, oldest first.

    The oldest of those times becomes a filter on the scan, so a stored table only reads the row
    groups that can hold them.
    """
    oldest = latest_timestamps(df, points).agg(F.min("timestamp"))
    return (
        df.where(F.col("timestamp") >= oldest.scalar())
        .groupBy("timestamp")
        .agg(
            rnd(F.avg("aqi"), 2).alias("avg_aqi"),
            rnd(F.avg("total_alerts"), 2).alias("avg_total_alerts"),
            rnd(F.max("max_risk_prob"), 4).alias("max_risk_prob"),
            F.count_if(F.col("total_alerts") > 0).alias("active_rows"),
        )
        .orderBy("timestamp")
    )


def _rate_aggregates(df: DataFrame) -> list[Column]:
    return [F.avg(alert).alias(f"rate_{alert}") for alert in ALERTS if alert in df.columns]


def _label_figures(
    df: DataFrame, training_rates: Mapping[str, float]
) -> dict[str, dict[str, Column]]:
    """Per label: current rate, training rate and gap, over the aggregated rates."""
    figures = {}
    for label, alert in zip(LABELS, ALERTS):
        if alert in df.columns:
            current = F.col(f"rate_{alert}")
            trained = F.lit(float(training_rates.get(label, 0.0)))
            figures[label] = {
                "current_rate": rnd(current, 4),
                "training_rate": rnd(trained, 4),
                "rate_gap": rnd(current - trained, 4),
            }
    return figures


def build_label_summary(
    df: DataFrame, training_rates: Mapping[str, float] = BASELINE_RATES
) -> DataFrame:
    """Current alert rate per label against the training rate."""
    return df.agg(*_rate_aggregates(df)).select(F.inline(F.array(*_label_rows(df, training_rates))))


def _label_rows(df: DataFrame, training_rates: Mapping[str, float]) -> list[Column]:
    """A struct per label, over the aggregated rates."""
    return [
        F.struct(
            F.lit(label).alias("label"),
            F.lit(LABEL_TITLES[label]).alias("display_name"),
            *[value.alias(name) for name, value in figures.items()],
        )
        for label, figures in _label_figures(df, training_rates).items()
    ]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(LABELS)) for j in range(i, len(LABELS))]


def _pair_counts(columns: Sequence[str]) -> list[Column]:
    """The row count and the 15 distinct pair counts, all aggregates of one pass."""
    return [F.count("*").alias("rows")] + [
        F.sum((F.col(columns[i]) * F.col(columns[j])).cast("bigint")).alias(f"n_{i}_{j}")
        for i, j in _pairs()
    ]


def _cell(i: int, j: int) -> Column:
    return F.col(f"n_{min(i, j)}_{max(i, j)}") / F.nullif(F.col("rows"), F.lit(0))


def label_cooccurrence(df: DataFrame, columns: Sequence[str] = LABELS) -> DataFrame:
    """Share of rows carrying both labels, long form, for all 25 ordered pairs."""
    cells = [
        F.struct(
            F.lit(LABELS[i]).alias("row_label"),
            F.lit(LABELS[j]).alias("col_label"),
            rnd(_cell(i, j), 4).alias("share"),
        )
        for i in range(len(LABELS))
        for j in range(len(LABELS))
    ]
    return df.agg(*_pair_counts(columns)).select(F.inline(F.array(*cells)))


def _gap(baseline: Sequence[Sequence[float]] | None) -> Column:
    """Mean absolute difference of the 25 alert shares to the training matrix; 0 without either."""
    if not baseline:
        return F.lit(0.0)
    deltas = [
        F.abs(_cell(i, j) - F.lit(float(share)))
        for i, row in enumerate(baseline)
        for j, share in enumerate(row)
    ]
    return F.coalesce(rnd(total(deltas) / len(deltas), 4), F.lit(0.0))


def cooccurrence_gap(
    df: DataFrame, baseline: Sequence[Sequence[float]] | None = BASELINE_COOCCURRENCE
) -> DataFrame:
    return df.agg(*_pair_counts(ALERTS)).select(_gap(baseline).alias("cooccurrence_gap"))


def _any_quality_flag(df: DataFrame) -> Column:
    flags = quality_flag_columns(df)
    return flag(total(F.col(c) for c in flags) > 0) if flags else F.lit(0)


def quality_flag_rate(df: DataFrame) -> DataFrame:
    """Share of rows with at least one quality or missing flag."""
    rate = rnd(F.avg(_any_quality_flag(df)), 4)
    return df.agg(F.coalesce(rate, F.lit(0.0)).alias("quality_flag_rate"))


def _monitoring_aggregates(df: DataFrame) -> list[Column]:
    return [F.avg(_any_quality_flag(df)).alias("flag_rate"), *_pair_counts(ALERTS)]


def _monitoring_figures(
    model: Mapping[str, object], baseline: Sequence[Sequence[float]] | None
) -> dict[str, Column]:
    stored = {
        "test_hamming_loss": "hamming_loss",
        "test_f1_macro": "f1_macro",
        "test_exact_match": "exact_match",
    }
    metrics = _selected_metrics(model)
    return {
        "quality_flag_rate": F.coalesce(rnd(F.col("flag_rate"), 4), F.lit(0.0)),
        "cooccurrence_gap": _gap(baseline),
        "model": F.lit(model.get("selected_model")).cast("string"),
        **{n: rnd(F.lit(metrics.get(key, 0.0)), 4) for n, key in stored.items()},
    }


def build_monitoring_summary(
    df: DataFrame,
    model: Mapping[str, object] = BASELINE_MODEL,
    baseline: Sequence[Sequence[float]] | None = BASELINE_COOCCURRENCE,
) -> DataFrame:
    """Quality rate, co-occurrence gap and the model's stored diagnostics; one scan, one row."""
    figures = _monitoring_figures(model, baseline)
    return df.agg(*_monitoring_aggregates(df)).select(*[c.alias(n) for n, c in figures.items()])


def _report_row(section: str, metric: Column, value: Column, numeric: bool = True) -> Column:
    """Long form: a text value for everything, a number where there is one."""
    number = value.cast("double") if numeric else F.lit(None).cast("double")
    return F.struct(
        F.lit(section).alias("section"),
        metric.alias("metric"),
        value.cast("string").alias("value"),
        number.alias("value_num"),
    )


def build_monitoring_report(
    df: DataFrame,
    training_rates: Mapping[str, float] = BASELINE_RATES,
    model: Mapping[str, object] = BASELINE_MODEL,
    baseline: Sequence[Sequence[float]] | None = BASELINE_COOCCURRENCE,
) -> DataFrame:
    """``section, metric, value, value_num``: overview, labels, monitoring, top stations.

    The first three sections are one pass over the scored rows."""
    figures = df.agg(
        *_overview_aggregates(df), *_rate_aggregates(df), *_monitoring_aggregates(df)
    )
    rows = [
        _report_row("overview", F.lit(c), _iso(F.col(c)), False)
        if c in OVERVIEW_TIMES
        else _report_row("overview", F.lit(c), F.col(c))
        for c in OVERVIEW_COLUMNS
    ]
    for label, values in _label_figures(df, training_rates).items():
        rows += [_report_row("label", F.lit(f"{label}_{n}"), c) for n, c in values.items()]
    for name, value in _monitoring_figures(model, baseline).items():
        rows.append(_report_row("monitoring", F.lit(name), value, name != "model"))
    stations = build_station_summary(df).limit(STATIONS_SHOWN)
    risk = _report_row(
        "station", F.concat("station_id", F.lit("_max_risk_prob")), F.col("max_risk_prob")
    )
    return figures.select(F.inline(F.array(*rows))).unionByName(
        stations.select(F.inline(F.array(risk)))
    )


def health_slice(df: DataFrame) -> DataFrame:
    overview = build_overview(df)
    return overview.select(
        F.when(F.col("readings_scored") > 0, F.lit("ok"))
        .otherwise(F.lit("no_predictions"))
        .alias("status"),
        F.col("readings_scored").alias("latest_predictions_count"),
        "latest_scored_at",
    )


def alerts_slice(df: DataFrame) -> DataFrame:
    """Station totals of the alerts view: all stations, and those whose latest row is active."""
    stations = build_station_summary(df)
    return stations.agg(
        F.count("*").alias("stations_total"),
        F.count_if(F.col("total_alerts") > 0).alias("stations_with_alerts"),
    )


def _band(risk: Column, threshold: float) -> Column:
    return F.when(risk >= threshold, F.lit("high")).otherwise(F.lit("normal"))


def station_bands(df: DataFrame, shown: int = STATIONS_SHOWN) -> DataFrame:
    stations = build_station_summary(df).limit(shown)
    return stations.select(
        "station_id", "max_risk_prob",
        _band(F.col("max_risk_prob"), STATION_HIGH_RISK).alias("severity"),
    )


def history_bands(df: DataFrame) -> DataFrame:
    """Rows per station and severity of the prediction history."""
    return df.groupBy(
        "station_id", _band(F.col("max_risk_prob"), HISTORY_HIGH_RISK).alias("severity")
    ).agg(F.count("*").alias("rows"))


def _document(rows: DataFrame, section: str) -> DataFrame:
    """Each row as a JSON text; times as the dashboard shows them."""
    columns = [_iso(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in rows.schema]
    return rows.select(
        F.lit(section).alias("section"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("document"),
    )


def _clock(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


def build_snapshot(
    df: DataFrame,
    training_rates: Mapping[str, float] = BASELINE_RATES,
    model: Mapping[str, object] = BASELINE_MODEL,
    baseline: Sequence[Sequence[float]] | None = BASELINE_COOCCURRENCE,
    alert_limit: int = 8,
    timeline_points: int = 24,
    now: Column | None = None,
) -> DataFrame:
    """Every dashboard section as rows ``section, document`` (JSON).

    Sections that grow with the data (stations) stay rows of a table instead of one big cell. ``df``
    is run once: its dashboard columns are stored, the figures of four sections are one aggregate over them,
    kept as one row, and alerts, stations and timeline read the columns they need.
    """
    rows = store(df.select(*[c for c in SNAPSHOT_COLUMNS if c in df.columns]), "snapshot-rows")
    figures = store(
        rows.agg(
            *_overview_aggregates(rows), *_rate_aggregates(rows), *_monitoring_aggregates(rows),
            _signature().alias("data_signature"),
        ),
        "snapshot-figures",
    )
    status = figures.select(F.lit("ok").alias("status"), _clock(now).alias("generated_at"), "data_signature")
    monitoring = [c.alias(n) for n, c in _monitoring_figures(model, baseline).items()]
    sections = {
        "status": status,
        "overview": figures.select(*OVERVIEW_COLUMNS),
        "alerts": build_recent_alerts(rows, alert_limit),
        "stations": build_station_summary(rows),
        "timeline": build_timeline(rows, timeline_points),
        "labels": figures.select(F.inline(F.array(*_label_rows(rows, training_rates)))),
        "monitoring": figures.select(*monitoring),
        "model": _model_row(df.sparkSession, model),
    }
    documents = [_document(rows, name) for name, rows in sections.items()]
    return reduce(DataFrame.unionByName, documents)


def empty_snapshot(
    spark: SparkSession, model: Mapping[str, object] = BASELINE_MODEL, now: Column | None = None
) -> DataFrame:
    """The snapshot before any prediction exists: status, zero figures and the model; alerts,
    stations, timeline and labels have no rows."""
    one = spark.range(1)
    status = one.select(F.lit("no_predictions").alias("status"), _clock(now).alias("generated_at"))
    zero = {c: F.lit(None).cast("timestamp") if c in OVERVIEW_TIMES else F.lit(0) for c in OVERVIEW_COLUMNS}
    none = one.where("id < 0").select(F.lit(0.0).alias("flag_rate"), *[F.lit(0).alias(a) for a in ALERTS])
    figures = none.agg(F.avg("flag_rate").alias("flag_rate"), *_pair_counts(ALERTS))
    sections = {
        "status": status,
        "overview": one.select(*[c.alias(n) for n, c in zero.items()]),
        "monitoring": figures.select(*[c.alias(n) for n, c in _monitoring_figures(model, None).items()]),
        "model": _model_row(spark, model, thresholds=False),
    }
    return reduce(DataFrame.unionByName, [_document(rows, name) for name, rows in sections.items()])


def snapshot_cells(snapshot: DataFrame) -> DataFrame:
    """``section, item, field, number, text``: a snapshot's documents field by field, nulls left out."""
    item = F.coalesce(*[F.when(F.col("section") == s, F.col("fields")[k]) for s, k in SNAPSHOT_KEYS.items()], F.lit(""))
    cells = snapshot.withColumn("fields", F.from_json("document", "map<string, string>"))
    cells = cells.select("section", item.alias("item"), F.explode("fields").alias("field", "value")).where("value is not null")
    number = F.col("value").try_cast("double")
    return cells.select("section", "item", "field", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


def _selected_metrics(model: Mapping[str, object]) -> dict[str, float]:
    """The figures of the selected model, of a stored metrics document or of a flat mapping."""
    stored = model.get("selected_metrics", model)
    return {k: float(v) for k, v in stored.items() if isinstance(v, int | float) and k != "feature_count"}


def _model_row(spark: SparkSession, model: Mapping[str, object], thresholds: bool = True) -> DataFrame:
    """Name, feature count, metrics and thresholds; what the metrics document lacks is null or empty."""
    candidate = model.get("candidate_metrics", {}).get(model.get("selected_model"), {})
    shown = {"metrics": _selected_metrics(model), "thresholds": candidate.get("thresholds", {})}
    documents = {n: F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) if m else F.create_map().cast("map<string, double>") for n, m in shown.items()}
    return spark.range(1).select(
        F.lit(model.get("selected_model")).cast("string").alias("selected_model"),
        F.lit(model.get("feature_count")).cast("bigint").alias("feature_count"),
        *[c.alias(n) for n, c in documents.items() if thresholds or n != "thresholds"],
    )


def _within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


def dashboard_view(
    df: DataFrame, alert_limit: int = 8, timeline_points: int = 24, **options
) -> DataFrame:
    """The snapshot with the bounds of the dashboard view: 1–20 alerts, 6–72 points."""
    return build_snapshot(
        df,
        alert_limit=_within("alert_limit", alert_limit, 1, 20),
        timeline_points=_within("timeline_points", timeline_points, 6, 72),
        **options,
    )


def alerts_view(df: DataFrame, limit: int = 10) -> DataFrame:
    """The recent alerts with the bounds of the alerts view: 1–25 rows."""
    return build_recent_alerts(df, _within("limit", limit, 1, 25))


def data_signature(df: DataFrame) -> DataFrame:
    """Changes whenever scored rows were added or replaced: newest scoring time and row count."""
    return df.agg(_signature().alias("data_signature"))


def _signature() -> Column:
    newest = F.coalesce(F.unix_micros(F.max("scored_at")).cast("string"), F.lit("none"))
    return F.concat_ws(":", newest, F.count("*").cast("string"))
