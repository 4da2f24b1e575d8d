"""Every operator as a named query over the given tables."""

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsense.functions.domain import aqi_from_pm25, calendar, season_of_month
from airsense.functions.numeric import rnd
from airsense.operators import clean, eda, evaluation, features, live, monitoring, quality, scoring
from airsense.operators.model_sql import add_document_probabilities
from airsense.operators.training import encode, fit_encoder
from airsense.plans.pipeline import score_readings, train
from airsense.plans.stored_models import STORED_MODELS
from airsense.schema import (
    ALERTS, CIRCULAR_FEATURES, COMPOSITE_FEATURES, IMPUTED_COLUMNS, LABELS, LIVE_BASE_COLUMNS,
    LOGGED_COLUMNS, MISSING_FLAGS, PROBS, RISK_FEATURES, ROLLING_FEATURES,
    SAMPLE_COLUMNS, THRESHOLDS, WEATHER_FEATURES,
)
from airsense.sources import history
from airsense.sources.driver_tables import (
    add_fixture_probabilities, add_fixture_scores, events, readings, readings_from_events,
)
from airsense.sources.readings import read_readings, write_table
from airsense.sources.stored import new_path, store
from airsense.streaming import ingest, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A fixed clock, so that queries which stamp rows can be compared.
NOW = datetime(2024, 2, 1, 8, 30, 0)
# Readings up to this day count as already stored, later ones as arriving.
STORED_UNTIL_DAY = 15


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def now():
    return F.lit(NOW).cast("timestamp")


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(F.col(c), digits) for c in columns})


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_sensor_duplicates(readings(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-wise cleaned readings, duplicates included: a narrow plan."""
    return clean.clean_rows(readings(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_fixture_scores(cleaned(spark, sf_dir))


def source_number():
    """The event number inside a reading id."""
    return F.expr("cast(substr(reading_id, 4) as bigint)")


# ---- validation ----


@query
def validation_counts(spark, sf_dir):
    return quality.duplicate_counts(readings(spark, sf_dir)).withColumn(
        "total_columns", F.col("total_columns").cast("int")
    )


@query
def validation_summary(spark, sf_dir):
    return quality.validation_summary(readings(spark, sf_dir))


@query
def missing_profile(spark, sf_dir):
    return quality.missing_profile(readings(spark, sf_dir))


@query
def physical_checks(spark, sf_dir):
    return quality.physical_checks(readings(spark, sf_dir))


@query
def rule_catalogue(spark, sf_dir):
    return quality.rule_catalogue(readings(spark, sf_dir))


@query
def duplicate_groups(spark, sf_dir):
    return quality.duplicate_groups(readings(spark, sf_dir))


@query
def problem_rows(spark, sf_dir):
    return quality.problem_rows(readings(spark, sf_dir))


@query
def numeric_profile(spark, sf_dir):
    profile = quality.numeric_profile(readings(spark, sf_dir))
    return rounded(profile, ("mean", "std", "min", "max", "q25", "q50", "q75"))


@query
def quality_summary(spark, sf_dir):
    return quality.quality_summary(readings(spark, sf_dir))


@query
def null_masks(spark, sf_dir):
    return quality.null_masks(readings(spark, sf_dir))


# ---- cleaning ----


@query
def aqi_reference(spark, sf_dir):
    return readings(spark, sf_dir).select(
        "reading_id", "pm25", aqi_from_pm25(F.col("pm25")).alias("aqi_reference_pm25")
    )


@query
def dedupe_first(spark, sf_dir):
    return deduped(spark, sf_dir)


@query
def clean_categories(spark, sf_dir):
    return clean.clean_categories(readings(spark, sf_dir)).select(
        "reading_id", "season", "station_type"
    )


@query
def missing_flags(spark, sf_dir):
    return clean.add_missing_flags(readings(spark, sf_dir)).select("reading_id", *MISSING_FLAGS)


@query
def sensor_quality_flags(spark, sf_dir):
    return clean.add_sensor_quality_flags(readings(spark, sf_dir)).select(
        "reading_id", "pm10_adjusted_flag", "aqi_reference_pm25", "aqi_gap", "aqi_gap_flag",
        "wind_speed_zero_flag",
    )


@query
def repair_pm10(spark, sf_dir):
    return clean.repair_physical_values(readings(spark, sf_dir)).select(
        "reading_id", "pm25", "pm10"
    )


@query
def impute_domain(spark, sf_dir):
    rows = clean.clean_categories(readings(spark, sf_dir))
    return clean.impute(rows, clean.fit_fill_values(rows)).select("reading_id", *IMPUTED_COLUMNS)


@query
def preprocess(spark, sf_dir):
    return clean.preprocess(readings(spark, sf_dir))


# ---- features ----


@query
def features_circular(spark, sf_dir):
    return features.add_circular_features(cleaned(spark, sf_dir)).select(
        "reading_id", *CIRCULAR_FEATURES
    )


@query
def features_composite(spark, sf_dir):
    out = features.add_composite_features(cleaned(spark, sf_dir))
    return rounded(out, [f"log_{c}" for c in LOGGED_COLUMNS]).select(
        "reading_id", *COMPOSITE_FEATURES
    )


@query
def features_weather(spark, sf_dir):
    return features.add_weather_station_features(cleaned(spark, sf_dir)).select(
        "reading_id", *WEATHER_FEATURES
    )


@query
def features_risk(spark, sf_dir):
    return features.add_risk_context_features(cleaned(spark, sf_dir)).select(
        "reading_id", *RISK_FEATURES
    )


@query
def features_rolling(spark, sf_dir):
    return features.add_rolling_features(readings(spark, sf_dir)).select(
        "reading_id", *ROLLING_FEATURES
    )


@query
def feature_frame(spark, sf_dir):
    frame = features.build_feature_frame(clean.preprocess(readings(spark, sf_dir)))
    return rounded(frame, [f"log_{c}" for c in LOGGED_COLUMNS])


@query
def feature_sample(spark, sf_dir):
    """The 100-row sample export in (station, time) order."""
    rows = cleaned(spark, sf_dir)
    rolled = features.add_rolling_features(rows)
    frame = features.add_weather_station_features(features.add_composite_features(rolled))
    return frame.orderBy("station_id", "timestamp", "reading_id").limit(100).select(*SAMPLE_COLUMNS)


# ---- live path ----


def payloads(rows: DataFrame) -> DataFrame:
    """One JSON payload per reading: objects and one-element lists, some fields absent or bad."""
    n = source_number()
    fields = {c: F.col(c) for c in LIVE_BASE_COLUMNS}
    fields["co"] = F.when(n % 13 != 0, F.col("co"))
    fields["pm25"] = F.when(n % 17 != 0, F.col("pm25").cast("string")).otherwise(F.lit("n/a"))
    fields["timestamp"] = F.when(
        n % 23 != 0, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    ).otherwise(F.lit("yesterday"))
    fields["reading_id"] = F.when(n % 19 != 0, F.col("reading_id"))
    record = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
    return rows.select(
        F.col("reading_id").alias("source"),
        F.when(n % 2 == 0, F.concat(F.lit("["), record, F.lit("]")))
        .otherwise(record)
        .alias("payload"),
    )


def land_payloads(spark, sf_dir) -> str:
    """The payload texts as they would arrive: a landing folder."""
    path = new_path(spark, "payloads")
    payloads(readings(spark, sf_dir)).write.parquet(path)
    return path


def landed_payloads(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(land_payloads(spark, sf_dir))


def masked_id():
    """Generated ids differ on every run; what can be compared is their form."""
    generated = F.col("reading_id").rlike("^LIVE-[0-9]{14}-[0-9a-f]{8}$")
    return F.when(generated, F.lit("generated")).otherwise(F.col("reading_id"))


@query
def live_normalise(spark, sf_dir):
    parsed = live.parse_payloads(landed_payloads(spark, sf_dir))
    return live.prepare_live_readings(live.payload_rows(parsed), now()).withColumn(
        "reading_id", masked_id()
    )


@query
def live_reject(spark, sf_dir):
    parsed = live.parse_payloads(landed_payloads(spark, sf_dir))
    return live.rejected_payloads(parsed).select("source", "error")


def batch_requests(rows: DataFrame) -> DataFrame:
    """Requests of 1 to 3 rows; some empty, some over the limit."""
    n = source_number()
    size = F.when(n % 50 == 0, 101).when(n % 51 == 0, 0).otherwise(1 + n % 3).cast("int")
    form = ("pm25", "pm10", "aqi", "temp_c", "humidity_pct", "season", "station_type")
    record = F.struct(*form, F.when(n % 2 == 0, F.col("wind_dir_deg")).alias("wind_dir_deg"))
    return rows.select(
        F.col("reading_id").alias("request_id"),
        F.to_json(F.struct(F.array_repeat(record, size).alias("rows"))).alias("payload"),
    )


@query
def batch_request_rows(spark, sf_dir):
    parsed = live.parse_batch_requests(batch_requests(readings(spark, sf_dir)))
    return live.prepare_batch_rows(parsed, now())


@query
def batch_request_errors(spark, sf_dir):
    parsed = live.parse_batch_requests(batch_requests(readings(spark, sf_dir)))
    return parsed.where("error is not null").select("request_id", "error")


@query
def payload_defaults(spark, sf_dir):
    form = readings(spark, sf_dir).select(
        "reading_id", "pm25", "pm10", "aqi", "temp_c", "humidity_pct", "wind_speed_ms", "season",
        "station_type", "pressure_hpa", "visibility_km", "benzene", "wind_dir_deg",
    )
    return live.apply_form_defaults(form)


@query
def single_request(spark, sf_dir):
    sent = readings(spark, sf_dir).select(F.col("reading_id").alias("source"), "pm25", "benzene")
    return live.single_request_defaults(sent, now())


@query
def temporal_columns(spark, sf_dir):
    rows = readings(spark, sf_dir)
    return rows.select(
        "reading_id", *[c.alias(name) for name, c in calendar(F.col("timestamp")).items()]
    )


@query
def season_from_month(spark, sf_dir):
    return readings(spark, sf_dir).select(
        "reading_id", "month", season_of_month(F.col("month")).alias("season")
    )


def writes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stored and arriving writes; the write key is a station and an hour of the day, so keys are
    written over and over."""
    rows = readings(spark, sf_dir).select(
        F.concat_ws("-", "station_id", F.lpad(F.col("hour").cast("string"), 2, "0")).alias(
            "reading_id"
        ),
        "station_id", "timestamp", "pm25", "aqi",
        F.col("reading_id").alias("written_as"),
        source_number().alias("sequence"),
    )
    stored = F.dayofmonth("timestamp") <= STORED_UNTIL_DAY
    return rows.where(stored), rows.where(~stored).withColumn("co", F.lit(1.5))


@query
def upsert_last_wins(spark, sf_dir):
    existing, arriving = writes(spark, sf_dir)
    return history.upsert(existing, arriving, order=("sequence", "written_as"))


@query
def history_append(spark, sf_dir):
    """Two appends to one history table, read back."""
    existing, arriving = writes(spark, sf_dir)
    path = new_path(spark, "history")
    for part in (existing, arriving.drop("co")):
        history.append_history(part, path)
    return spark.read.parquet(path).groupBy("station_id").agg(
        F.count("*").alias("rows"),
        F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"),
    )


@query
def history_tail(spark, sf_dir):
    return history.history_tail(scored(spark, sf_dir), 20).select(
        "reading_id", "station_id", "scored_at", "total_alerts", "alert_signature"
    )


@query
def active_source(spark, sf_dir):
    """Live predictions win when there are any; here they are the ones with alerts."""
    batch = scored(spark, sf_dir)
    chosen = history.active_predictions(batch.where("total_alerts > 0"), batch)
    return chosen.select("reading_id", "total_alerts")


@query
def csv_round_trip(spark, sf_dir):
    """Readings written as CSV text and scanned back into the contract."""
    path = new_path(spark, "csv")
    write_table(readings(spark, sf_dir), path, "csv")
    return read_readings(spark, path)


# ---- scoring ----


@query
def score_alerts(spark, sf_dir):
    rows = add_fixture_probabilities(readings(spark, sf_dir))
    return scoring.add_alerts(rows, THRESHOLDS).select("reading_id", *PROBS, *ALERTS)


@query
def score_summary(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "reading_id", "total_alerts", "max_risk_prob", "dominant_risk", "alert_signature",
        "scored_at", "model_version",
    )


@query
def alert_signature(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("alert_signature").agg(F.count("*").alias("rows"))


@query
def predictions_backfill(spark, sf_dir):
    older = scored(spark, sf_dir).drop("max_risk_prob", "dominant_risk", "alert_signature")
    return scoring.backfill_summary(older).select(
        "reading_id", "max_risk_prob", "dominant_risk", "alert_signature"
    )


@query
def ingest_response(spark, sf_dir):
    return scoring.ingest_response(scored(spark, sf_dir))


# ---- monitoring ----


@query
def overview(spark, sf_dir):
    return monitoring.build_overview(scored(spark, sf_dir))


@query
def recent_alerts(spark, sf_dir):
    return monitoring.build_recent_alerts(scored(spark, sf_dir))


@query
def station_summary(spark, sf_dir):
    return monitoring.build_station_summary(scored(spark, sf_dir))


@query
def timeline(spark, sf_dir):
    return monitoring.build_timeline(scored(spark, sf_dir))


@query
def label_drift(spark, sf_dir):
    return monitoring.build_label_summary(scored(spark, sf_dir))


@query
def quality_flag_rate(spark, sf_dir):
    return monitoring.quality_flag_rate(scored(spark, sf_dir))


@query
def cooccurrence(spark, sf_dir):
    return monitoring.label_cooccurrence(readings(spark, sf_dir))


@query
def cooccurrence_gap(spark, sf_dir):
    return monitoring.cooccurrence_gap(scored(spark, sf_dir))


@query
def monitoring_summary(spark, sf_dir):
    return monitoring.build_monitoring_summary(scored(spark, sf_dir))


@query
def monitoring_report(spark, sf_dir):
    """The numeric values; text renderings of floats differ between engines."""
    report = monitoring.build_monitoring_report(scored(spark, sf_dir))
    text = F.when(F.col("value_num").isNull(), F.col("value"))
    return report.select("section", "metric", text.alias("value"), "value_num")


@query
def dashboard_snapshot(spark, sf_dir):
    """All sections of the dashboard at a fixed time, field by field."""
    return monitoring.snapshot_cells(monitoring.build_snapshot(scored(spark, sf_dir), now=now()))


@query
def health_slice(spark, sf_dir):
    return monitoring.health_slice(scored(spark, sf_dir))


@query
def alerts_slice(spark, sf_dir):
    return monitoring.alerts_slice(scored(spark, sf_dir))


@query
def station_bands(spark, sf_dir):
    return monitoring.station_bands(scored(spark, sf_dir))


@query
def risk_bands(spark, sf_dir):
    return monitoring.history_bands(scored(spark, sf_dir))


# ---- evaluation ----


@query
def time_split(spark, sf_dir):
    return evaluation.time_split(readings(spark, sf_dir)).select("reading_id", "split")


@query
def time_split_two_way(spark, sf_dir):
    split = evaluation.time_split(
        readings(spark, sf_dir), validation_share=0.0, validation_minimum=0
    )
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.min("timestamp").alias("since"))


@query
def threshold_curve(spark, sf_dir):
    curve = evaluation.threshold_curve(add_fixture_probabilities(readings(spark, sf_dir)))
    return rounded(curve, ("threshold", "f1"))


@query
def threshold_tuning(spark, sf_dir):
    return evaluation.tune_thresholds(add_fixture_probabilities(readings(spark, sf_dir)))


@query
def threshold_tuning_strict(spark, sf_dir):
    rows = add_fixture_probabilities(readings(spark, sf_dir))
    tuned = evaluation.tune_thresholds(rows, evaluation.WIDE_GRID, prefer_middle=False)
    return rounded(tuned, ("threshold",))


@query
def multilabel_metrics(spark, sf_dir):
    return rounded(evaluation.evaluate_multilabel(scored(spark, sf_dir)), ("value",))


@query
def label_rates(spark, sf_dir):
    return evaluation.label_rates(readings(spark, sf_dir))


@query
def class_weights(spark, sf_dir):
    return rounded(evaluation.class_weights(readings(spark, sf_dir)), ("weight",))


CANDIDATE_THRESHOLDS = {
    "shipped": THRESHOLDS,
    "low": dict.fromkeys(LABELS, 0.3),
    "high": dict.fromkeys(LABELS, 0.7),
}


def candidate_metrics(spark, sf_dir) -> dict[str, DataFrame]:
    """Three sets of thresholds over the same probabilities stand for three models."""
    rows = add_fixture_probabilities(readings(spark, sf_dir))
    return {
        name: evaluation.evaluate_multilabel(scoring.add_alerts(rows, thresholds))
        for name, thresholds in CANDIDATE_THRESHOLDS.items()
    }


def candidates(spark, sf_dir) -> DataFrame:
    judged = candidate_metrics(spark, sf_dir)
    rows = [evaluation.headline_metrics(metrics, name) for name, metrics in judged.items()]
    return reduce(DataFrame.unionByName, rows)


METRIC_NAMES = ("hamming_loss", "f1_micro", "f1_macro", "exact_match", "jaccard_samples")


@query
def model_comparison(spark, sf_dir):
    return rounded(candidates(spark, sf_dir), METRIC_NAMES)


@query
def model_selection(spark, sf_dir):
    return rounded(evaluation.select_model(candidates(spark, sf_dir)), METRIC_NAMES)


@query
def per_label_f1(spark, sf_dir):
    table = evaluation.per_label_f1(candidate_metrics(spark, sf_dir))
    return rounded(table, list(CANDIDATE_THRESHOLDS))


@query
def preprocessor_stats(spark, sf_dir):
    rows = readings(spark, sf_dir)
    stats = evaluation.numeric_stats(rows, quality.numeric_columns(rows))
    return rounded(stats, ("median", "mean", "scale"))


@query
def category_modes(spark, sf_dir):
    return evaluation.most_frequent(cleaned(spark, sf_dir), ("season", "station_id", "station_type"))


ENCODED_COLUMNS = ("pm25", "benzene", "visibility_km", "wind_speed_ms", "season", "station_type")


@query
def encoded_vectors(spark, sf_dir):
    """The vectors a model sees, an entry a row: numbers filled and standardised, then categories."""
    rows = readings(spark, sf_dir)
    encoded = encode(fit_encoder(rows, ENCODED_COLUMNS), rows, ENCODED_COLUMNS)
    entries = F.posexplode(vector_to_array("features")).alias("place", "value")
    return rounded(encoded.select("reading_id", entries), ("value",))


def model_scores(spark, sf_dir, name: str) -> DataFrame:
    """Probabilities, alerts and summary of a stored model, fitted earlier."""
    with_probabilities = add_document_probabilities(readings(spark, sf_dir), STORED_MODELS[name])
    summed = scoring.add_score_summary(scoring.add_alerts(with_probabilities, THRESHOLDS), now(), name)
    return rounded(summed, PROBS).select(
        "reading_id", *PROBS, *ALERTS, "total_alerts", "dominant_risk", "alert_signature", "model_version"
    )


@query
def chain_scores(spark, sf_dir):
    """A classifier chain: each regression sees what the ones before it decided."""
    return model_scores(spark, sf_dir, "classifier_chain_lr")


@query
def forest_scores(spark, sf_dir):
    return model_scores(spark, sf_dir, "random_forest")


@query
def extra_trees_scores(spark, sf_dir):
    return model_scores(spark, sf_dir, "extra_trees")


@query
def train_and_score(spark, sf_dir):
    """Full-size candidates trained on the whole table, the best one scoring it."""
    rows = readings(spark, sf_dir)
    model = train(rows)
    return score_readings(rows, model, scored_at=now()).select(
        "reading_id", "station_id", *PROBS, *ALERTS, "total_alerts", "max_risk_prob",
        "dominant_risk", "alert_signature", "scored_at", "model_version",
    )


# ---- exploration ----


@query
def label_prevalence(spark, sf_dir):
    return rounded(eda.label_prevalence(readings(spark, sf_dir)), ("positive_rate",))


@query
def label_cardinality(spark, sf_dir):
    return eda.label_cardinality(readings(spark, sf_dir))


@query
def pollutant_quartiles(spark, sf_dir):
    box = eda.pollutant_quartiles(eda.title_categories(readings(spark, sf_dir)))
    return rounded(box, ("q25", "q50", "q75"))


@query
def season_hour_pivot(spark, sf_dir):
    pivot = eda.season_hour_pivot(eda.title_categories(readings(spark, sf_dir)))
    return rounded(pivot, [c for c in pivot.columns if c != "season"])


@query
def inversion_histogram(spark, sf_dir):
    return eda.inversion_histogram(readings(spark, sf_dir))


@query
def inversion_summary(spark, sf_dir):
    return eda.inversion_summary(readings(spark, sf_dir))


# ---- streams: the events table read as a file stream until it is exhausted ----


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a file stream, be it one file or a folder of part files."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(events(spark, sf_dir).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if any(name.endswith("/events.parquet") for name in spark.read.parquet(path).inputFiles()):
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return reader.parquet(path)


def drain_updates(stream: DataFrame, spark: SparkSession, name: str, key: str) -> DataFrame:
    """Run an update stream to its end; of every key, the row of the last batch that gave it out.

    A batch that is run again replaces its own folder.
    """
    folder = new_path(spark, name)
    running = (
        stream.writeStream.foreachBatch(
            lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/table/batch={batch:09d}")
        )
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    rows = spark.read.parquet(f"{folder}/table")
    last = F.max_by(F.struct(*stream.columns), "batch").alias("row")
    return rows.groupBy(F.col(key).alias("key")).agg(last).select("row.*")


def drain(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run an append stream into a table to its end and return the table."""
    folder = new_path(spark, name)
    running = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


@query
def stream_ingest(spark, sf_dir):
    """Payload stream to stored, scored readings; the current state of the predictions."""
    folder = new_path(spark, "ingest")

    def score(rows: DataFrame) -> DataFrame:
        return add_fixture_scores(clean.clean_rows(rows))

    landed = land_payloads(spark, sf_dir)
    stream = spark.readStream.schema("source string, payload string").parquet(landed)
    running = ingest.start_ingest(stream, folder, score, "source", {"availableNow": True})
    running.awaitTermination()
    state = ingest.current(spark, folder, ingest.PREDICTIONS, "source")
    # Rows without a sent time are stamped with the clock and left out of the comparison columns.
    return state.withColumn("reading_id", masked_id()).select(
        "reading_id", "source", "station_id", "total_alerts", "max_risk_prob", "dominant_risk",
        "alert_signature",
    )


@query
def stream_hourly(spark, sf_dir):
    rows = readings_from_events(event_stream(spark, sf_dir))
    return drain_updates(windows.hourly_timeline(add_fixture_scores(rows)), spark, "hourly", "window_start")


@query
def stream_first_per_reading(spark, sf_dir):
    rows = readings_from_events(event_stream(spark, sf_dir)).select(
        source_number().cast("string").alias("reading_id"), "timestamp", "station_id"
    )
    # every row lands; a reading of any day may still come in a later batch
    return windows.first_per_reading(drain(rows, spark, "first"))


@query
def stream_rolling(spark, sf_dir):
    folder = new_path(spark, "rolling")
    rows = readings_from_events(event_stream(spark, sf_dir))
    ingest.start_rolling(rows, folder, {"availableNow": True}).awaitTermination()
    return spark.read.parquet(f"{folder}/{ingest.ROLLED}").drop(history.BATCH_COLUMN)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, score and summarise: the latest state of every station."""
    rows = clean.preprocess(readings(spark, sf_dir))
    return monitoring.build_station_summary(store(add_fixture_scores(rows), "scored"))


