"""Payloads, streams, artifacts and the train/score flow."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from airsense.operators import clean, features, live
from airsense.operators.training import SMALL_SETTINGS, CANDIDATES
from airsense.plans.pipeline import load_model, save_model, score_readings, train
from airsense.schema import (
    LIVE_REQUIRED_COLUMNS, LIVE_BASE_COLUMNS, LABELS, PROBS, READING_COLUMNS, ROLLING_FEATURES,
)
from airsense.sources import artifacts, history
from airsense.sources.driver_tables import add_fixture_scores
from airsense.streaming import ingest

GOOD = dict.fromkeys(LIVE_REQUIRED_COLUMNS, 1) | {
    "station_id": "s", "station_type": "Urban", "reading_id": "r1", "timestamp": "2024-03-02 07:15:00",
}


def payload_table(spark, values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "n int, payload string")


def test_payload_verdicts(spark):
    without_co = {k: v for k, v in GOOD.items() if k != "co"}
    parsed = live.parse_payloads(
        payload_table(
            spark,
            [GOOD, [GOOD, without_co], without_co, [], "not json", [1, 2], GOOD | {"co": None},
             {k: v for k, v in GOOD.items() if k not in ("co", "station_id")}],
        )
    )
    rejected = {r["n"]: r["error"] for r in live.rejected_payloads(parsed).collect()}
    assert rejected == {
        2: "Missing required fields: co",
        3: live.NO_READING,
        4: live.UNREADABLE,
        5: live.UNREADABLE,
        7: "Missing required fields: station_id, co",
    }
    rows = live.payload_rows(parsed).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in rows} == {0: 1, 1: 2, 6: 1}


def test_live_row_completion(spark):
    rows = payload_table(
        spark, [GOOD, {k: v for k, v in GOOD.items() if k not in ("reading_id", "timestamp")}, GOOD | {"pm25": "high"}]
    )
    out = live.prepare_live_readings(live.payload_rows(live.parse_payloads(rows))).orderBy("n")
    assert out.columns == ["n", "payload_position", *READING_COLUMNS]
    first, second, third = out.collect()
    assert first["timestamp"] == datetime(2024, 3, 2, 7, 15)
    assert (first["season"], first["day_of_week"], first["is_weekend"], first["is_rush_hour"]) == (
        "Spring", 5, 1, 1,
    )
    assert second["reading_id"].startswith("LIVE-") and second["timestamp"].microsecond == 0
    assert third["pm25"] is None and third["pm10"] == 1.0
    assert all(first[label] is None for label in LABELS)


def test_batch_requests(spark):
    row = {"pm25": 5, "season": "Winter"}
    parsed = live.parse_batch_requests(
        payload_table(
            spark,
            [{"rows": [row, row]}, {"rows": []}, {}, {"rows": [row] * 101},
             {"rows": [row | {"wind_dir_deg": 90}, row | {"wind_dir_deg": None}]}],
        )
    )
    errors = {r["n"]: r["error"] for r in parsed.where("error is not null").collect()}
    assert errors == {1: live.NO_ROWS, 2: live.NO_ROWS, 3: "Batch limit is 100 rows"}
    rows = live.prepare_batch_rows(parsed).orderBy("n", "reading_id").collect()
    assert [(r["n"], r["reading_id"], r["wind_dir_deg"]) for r in rows] == [
        (0, "BATCH_0000", 180.0), (0, "BATCH_0001", 180.0),
        (4, "BATCH_0000", 90.0), (4, "BATCH_0001", None),
    ]
    assert {r["season"] for r in rows} == {"Winter"}


def test_form_defaults(spark):
    form = spark.createDataFrame(
        [(None, 0.0, "", None)], "pm25 double, temp_c double, season string, station_type string"
    )
    row = live.apply_form_defaults(form).first()
    assert (row["pm25"], row["temp_c"], row["season"], row["station_type"]) == (0.0, 20.0, "Spring", "Urban")
    assert (row["pressure_hpa"], row["station_id"], row["near_highway"]) == (1013.0, "BATCH_AUTO", 0)


@pytest.fixture
def landing(spark, tmp_path, raw):
    """Payload files arriving one after the other; the second repeats ids of the first."""
    folder = tmp_path / "landing"
    base = raw.select(*LIVE_BASE_COLUMNS).where("reading_id like 'RDG%'").orderBy("reading_id").limit(120)
    for part, shift in ((0, 0.0), (1, 100.0)):
        rows = base.withColumn("pm25", F.col("pm25") + shift)
        rows.select(
            F.concat(F.lit(f"{part}-"), "reading_id").alias("source"),
            F.to_json(F.struct(*LIVE_BASE_COLUMNS), {"ignoreNullFields": "false"}).alias("payload"),
        ).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def score(rows):
    return add_fixture_scores(clean.clean_rows(rows))


def test_ingest_stream_keeps_the_last_write(spark, tmp_path, landing):
    folder = str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema("source string, payload string").option("maxFilesPerTrigger", 1).parquet(landing)
        ingest.start_ingest(stream, folder, score, "source", {"availableNow": True}).awaitTermination()

    run()
    written = spark.read.parquet(f"{folder}/{ingest.READINGS}")
    assert written.count() == 240 and written.select(history.BATCH_COLUMN).distinct().count() == 2
    state = ingest.current(spark, folder, ingest.PREDICTIONS, "source")
    assert state.count() == 120
    assert state.where("pm25 < 100").isEmpty()

    signature = ingest.refresh_dashboard(spark, folder, "source", None)
    assert spark.read.text(f"{folder}/snapshot").count() > 30
    assert ingest.refresh_dashboard(spark, folder, "source", signature) == signature
    run()  # nothing new arrived
    assert spark.read.parquet(f"{folder}/{ingest.READINGS}").count() == 240


def test_a_repeated_batch_replaces_itself(spark, tmp_path, raw):
    path = str(tmp_path / "table")
    for _ in range(2):
        history.write_batch(raw.limit(50), path, 3)
    assert spark.read.parquet(path).count() == 50


def test_rolling_stream_continues_over_batches(spark, tmp_path, raw):
    folder, source = str(tmp_path / "rolling"), str(tmp_path / "source")
    days = raw.withColumn("day", F.dayofmonth("timestamp"))
    for low, high in ((1, 10), (11, 20), (21, 31)):
        days.where(F.col("day").between(low, high)).drop("day").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(raw.schema).parquet(source)
        ingest.start_rolling(stream, folder, {"availableNow": True}).awaitTermination()
    columns = ["reading_id", *ROLLING_FEATURES]
    streamed = spark.read.parquet(f"{folder}/{ingest.ROLLED}")
    assert streamed.where("late").isEmpty()
    assert streamed.select(columns).exceptAll(features.add_rolling_features(raw).select(columns)).isEmpty()
    assert streamed.count() == raw.count()


def test_artifacts(spark, tmp_path):
    assert artifacts.read_metrics(spark, str(tmp_path / "none.json")) == {}
    assert artifacts.read_feature_columns(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "metrics.json").write_text(
        json.dumps({"selected_model": "m", "selected_metrics": {"f1_macro": 0.5}, "training_label_rates": {LABELS[0]: 0.25}}, indent=2)
    )
    found = artifacts.read_metrics(spark, str(tmp_path / "metrics.json"))
    assert found["selected_metrics"]["f1_macro"] == 0.5
    assert found["training_label_rates"] == {LABELS[0]: 0.25}
    assert "feature_count" not in found
    artifacts.write_document(spark, ["a", "b"], str(tmp_path / "list.json"))
    assert artifacts.read_feature_columns(spark, str(tmp_path / "list.json")) == ["a", "b"]


def test_history_keeps_signatures_as_text(spark, tmp_path):
    path = str(tmp_path / "history")
    for signature in ("00100", "10000"):
        rows = spark.createDataFrame([("x", signature)], "reading_id string, alert_signature string")
        history.append_history(rows, path)
    assert {r[1] for r in history.read_table(spark, path).collect()} == {"00100", "10000"}
    assert history.read_table(spark, str(tmp_path / "nothing")) is None


def test_train_save_load_score(spark, tmp_path, raw):
    model = train(raw, SMALL_SETTINGS, {k: CANDIDATES[k] for k in CANDIDATES})
    assert model.name in CANDIDATES
    assert model.summary["feature_count"] == 75
    assert model.summary["split_rows"] == {"train": 675, "validation": 125, "test": 200}
    assert model.summary["selected_metrics"]["f1_macro"] > 0.5
    folder = str(tmp_path / "model")
    save_model(spark, model, folder)
    assert load_model(spark, folder).feature_columns == model.feature_columns
    artifacts.write_document(spark, ["aqi", "column of an older model"], f"{folder}/feature_columns.json")
    loaded = load_model(spark, folder)
    assert loaded.name == model.name and dict(loaded.thresholds) == dict(model.thresholds)
    stamp = F.lit(datetime(2024, 2, 1)).cast("timestamp")
    first = score_readings(raw, model, scored_at=stamp)
    again = score_readings(raw, loaded, scored_at=stamp)
    columns = ["reading_id", *PROBS, "total_alerts", "alert_signature"]
    assert first.select(columns).exceptAll(again.select(columns)).isEmpty()
    assert first.count() == 1000
    assert first.where("total_alerts <> length(replace(alert_signature, '0', ''))").isEmpty()
    unseen = raw.withColumn("station_id", F.lit("never seen"))
    assert score_readings(unseen, loaded).where(f"{PROBS[0]} is null").isEmpty()


def test_dashboard_follows_changes(spark, tmp_path, raw):
    import glob

    folder, table = str(tmp_path / "board"), str(tmp_path / "board" / ingest.PREDICTIONS)
    rows = add_fixture_scores(clean.clean_rows(raw)).withColumns({"source": F.col("reading_id"), "payload_position": F.lit(0)})

    def run():
        changes = spark.readStream.schema("reading_id string").parquet(table)
        ingest.start_dashboard(changes, folder, "source", {"availableNow": True}).awaitTermination()
        return sorted(glob.glob(f"{folder}/{ingest.SNAPSHOT}/part-*"))

    history.write_batch(rows.limit(100), table, 0)
    first = run()
    assert first and ingest.shown_signature(spark, folder).endswith(":100")
    history.write_batch(rows.limit(0), table, 1)
    assert run() == first  # an empty batch, after a restart
    assert run() == first  # nothing new at all
    history.write_batch(rows.exceptAll(rows.limit(100)).limit(7), table, 2)
    assert run() != first and ingest.shown_signature(spark, folder).endswith(":107")


def test_snapshot_of_a_stored_model(spark, raw):
    from airsense.operators import monitoring

    stored = {"selected_model": "m", "feature_count": 75, "selected_metrics": {"f1_macro": 0.5}, "candidate_metrics": {"m": {"thresholds": {LABELS[0]: 0.25}}}}
    stamp = F.lit(datetime(2024, 2, 1)).cast("timestamp")
    full = monitoring.build_snapshot(add_fixture_scores(clean.clean_rows(raw)), model=stored, now=stamp)
    none = monitoring.empty_snapshot(spark, stored, stamp)
    documents = {r["section"]: json.loads(r["document"]) for r in full.collect()}
    empty = {r["section"]: json.loads(r["document"]) for r in none.collect()}
    assert documents["model"] == {"selected_model": "m", "feature_count": 75, "metrics": {"f1_macro": 0.5}, "thresholds": {LABELS[0]: 0.25}}
    assert documents["monitoring"]["test_f1_macro"] == 0.5 and documents["status"]["generated_at"] == "2024-02-01T00:00:00"
    assert set(empty) == {"status", "overview", "monitoring", "model"} and empty["status"]["status"] == "no_predictions"
    assert empty["overview"] == {c: None if "latest" in c else 0 for c in monitoring.OVERVIEW_COLUMNS}
    assert (empty["monitoring"]["quality_flag_rate"], empty["monitoring"]["cooccurrence_gap"]) == (0.0, 0.0)
    assert empty["model"] == {"selected_model": "m", "feature_count": 75, "metrics": {"f1_macro": 0.5}}
