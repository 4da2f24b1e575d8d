"""Rules at their edges, on rows written out here."""

import pytest
from pyspark.sql import functions as F

from airsense.functions.domain import aqi_from_pm25, clean_season, clean_station_type, title_case
from airsense.functions.numeric import rnd
from airsense.operators import clean, evaluation, features, monitoring, scoring
from airsense.schema import (
    ALERTS, FEATURE_COLUMNS, LABELS, LIVE_REQUIRED_COLUMNS, MISSING_FLAGS, PROBS, READING_COLUMNS,
    READING_SCHEMA, THRESHOLDS,
)
from airsense.sources import history
from airsense.sources.readings import conform


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", make(F.col("v"))).orderBy("i").collect()]


def reading(**values):
    return tuple(values.get(c) for c in READING_COLUMNS)


def frame(spark, rows):
    return spark.createDataFrame([reading(**r) for r in rows], READING_SCHEMA)


def test_contract_sizes():
    assert len(READING_COLUMNS) == 35
    assert len(LIVE_REQUIRED_COLUMNS) == 17
    assert len(FEATURE_COLUMNS) == 75
    assert len(set(FEATURE_COLUMNS)) == 75


def test_aqi_segments(spark):
    values = [0.0, 12.0, 12.1, 35.4, 55.5, 500.4, 500.5, 12.05, 35.45, -1.0, None, float("nan")]
    expected = [0, 50, 51, 100, 151, 500, 500, 0, 0, 0, 0, 0]
    assert column(spark, values, "double", aqi_from_pm25) == expected
    assert column(spark, [18.1, 15.7, 3.1], "double", aqi_from_pm25) == [64, 59, 13]


def test_rounding_is_half_even_without_negative_zero(spark):
    values = [0.125, 0.375, 2.675, -0.001]
    result = column(spark, values, "double", lambda c: rnd(c, 2))
    assert result == [0.12, 0.38, 2.68, 0.0]
    assert str(result[3]) == "0.0"


def test_categories(spark):
    seasons = [" autumn ", "WINTER", "monsoon", None, "\tfall\n"]
    assert column(spark, seasons, "string", clean_season) == [
        "Fall", "Winter", "Unknown", "Unknown", "Fall",
    ]
    types = [" urban ", "SUBURBAN", None, "semi-urban area", "zone2b"]
    assert column(spark, types, "string", clean_station_type) == [
        "Urban", "Suburban", "Unknown", "Semi-Urban Area", "Zone2B",
    ]
    assert column(spark, ["o'neil park"], "string", title_case) == ["O'Neil Park"]


def test_repair_and_flags(spark):
    rows = [
        {"reading_id": "a", "pm25": 10.0, "pm10": 8.0, "aqi": 72, "wind_speed_ms": 0.0},
        {"reading_id": "b", "pm25": 10.0, "pm10": None, "aqi": 73, "wind_speed_ms": None},
        {"reading_id": "c", "pm25": None, "pm10": 5.0, "aqi": None, "wind_speed_ms": 1.0},
    ]
    out = {r["reading_id"]: r for r in clean.clean_rows(frame(spark, rows)).collect()}
    assert (out["a"]["pm10"], out["a"]["pm10_adjusted_flag"]) == (15.0, 1)
    assert (out["b"]["pm10"], out["b"]["pm10_adjusted_flag"]) == (None, 0)
    # The reference index of 10.0 is 42: a gap of exactly 30 does not count, 31 does.
    assert [out[k]["aqi_gap"] for k in "abc"] == [30.0, 31.0, None]
    assert [out[k]["aqi_gap_flag"] for k in "abc"] == [0, 1, 0]
    assert [out[k]["wind_speed_zero_flag"] for k in "abc"] == [1, 0, 0]
    assert all(out["a"][f] in (0, 1) for f in MISSING_FLAGS)


def test_median_fallbacks(spark):
    rows = [
        {"reading_id": "a", "station_type": "Urban", "month": 1, "benzene": 1.0},
        {"reading_id": "b", "station_type": "Urban", "month": 1, "benzene": 4.0},
        {"reading_id": "c", "station_type": "Urban", "month": None, "pressure_hpa": 1000.0},
        {"reading_id": "d", "station_type": "Rural", "month": None},
    ]
    out = {r["reading_id"]: r for r in clean.preprocess(frame(spark, rows)).collect()}
    assert out["c"]["benzene"] == 2.5  # group median
    assert out["d"]["benzene"] == 2.5  # no value in its group: overall median
    assert out["d"]["pressure_hpa"] == 1000.0
    assert (out["d"]["visibility_km"], out["d"]["wind_dir_deg"]) == (1.0, 180.0)


def test_invariants_after_cleaning(raw):
    cleaned = clean.preprocess(raw)
    assert cleaned.count() == raw.drop("reading_id").distinct().count()
    assert cleaned.where("pm10 < pm25").isEmpty()
    assert cleaned.where("season not in ('Winter','Spring','Summer','Fall','Unknown')").isEmpty()
    assert cleaned.where("benzene is null or pressure_hpa is null or visibility_km is null or wind_dir_deg is null").isEmpty()
    again = clean.drop_sensor_duplicates(clean.drop_sensor_duplicates(raw))
    assert again.exceptAll(clean.drop_sensor_duplicates(raw)).isEmpty()


def test_results_do_not_depend_on_row_order(raw):
    shuffled = raw.repartition(7, F.rand(1))
    for build in (clean.preprocess, lambda d: features.build_feature_frame(clean.clean_rows(d))):
        assert build(raw).exceptAll(build(shuffled)).isEmpty()


def test_wind_sector_ends(spark):
    rows = [
        {"reading_id": str(d), "near_industry": 1, "wind_dir_deg": d}
        for d in (179.9, 180.0, 315.0, 315.1, None)
    ]
    out = features.add_weather_station_features(frame(spark, rows)).collect()
    assert [r["industrial_downwind"] for r in out] == [0, 1, 1, 0, 1]


def test_rolling_skips_nulls_and_unknown_stations(spark):
    rows = [
        {"reading_id": str(i), "station_id": "s", "timestamp": t, "pm25": v}
        for i, (t, v) in enumerate(
            [(1, 1.0), (2, None), (3, 3.0), (4, 8.0)]
        )
    ]
    from datetime import datetime

    for r in rows:
        r["timestamp"] = datetime(2024, 1, 1, r["timestamp"])
    rows.append({"reading_id": "x", "station_id": None, "timestamp": datetime(2024, 1, 1), "pm25": 9.0})
    out = features.add_rolling_features(frame(spark, rows)).orderBy("reading_id").collect()
    assert [r["pm25_roll3_mean"] for r in out] == [1.0, 1.0, 2.0, 5.5, None]
    assert [r["pm25_lag1"] for r in out] == [None, 1.0, None, 3.0, None]
    assert [r["pm25_rising"] for r in out] == [0, 0, 0, 0, 0]


def test_scoring_edges(spark):
    df = spark.createDataFrame(
        [("tie", 0.5, 0.5, 0.5, 0.5, 0.5), ("mix", 0.8, 0.3, 0.9, 0.4, 0.6)],
        "reading_id string, " + ", ".join(f"{p} double" for p in PROBS),
    )
    half = dict.fromkeys(LABELS, 0.5)
    out = scoring.add_score_summary(scoring.add_alerts(df, half), model_version="stub")
    tie, mix = out.orderBy(F.desc("reading_id")).collect()
    assert (tie["dominant_risk"], tie["total_alerts"], tie["alert_signature"]) == (
        "respiratory_risk", 5, "11111",
    )
    assert (mix["dominant_risk"], mix["total_alerts"], mix["alert_signature"]) == (
        "vulnerable_alert", 3, "10101",
    )
    assert mix["model_version"] == "stub"


def test_feature_column_precedence():
    available = ["expected_a", "expected_b", "extra", "reading_id"]
    assert scoring.resolve_feature_columns(available, ["expected_a", "expected_b"], ["expected_a"]) == [
        "expected_a", "expected_b",
    ]
    assert scoring.resolve_feature_columns(available, None, ["expected_a"]) == ["expected_a"]
    assert scoring.resolve_feature_columns(available, None, None, ["extra"]) == ["extra"]
    assert scoring.resolve_feature_columns(available) == ["expected_a", "expected_b", "extra"]


def test_split_sizes():
    assert evaluation.split_sizes(1000) == (675, 800)
    assert evaluation.split_sizes(10_000) == (7000, 8000)
    assert evaluation.split_sizes(100) == (0, 80)


def test_metrics_without_any_label(spark):
    columns = ", ".join(f"{c} int" for c in (*LABELS, *ALERTS))
    df = spark.createDataFrame([(0,) * 10, (1, 0, 0, 0, 0, 1, 1, 0, 0, 0)], columns)
    out = {(r["metric"], r["label"]): r["value"] for r in evaluation.evaluate_multilabel(df).collect()}
    assert out[("jaccard_samples", "all")] == 0.25
    assert out[("hamming_loss", "all")] == 0.1
    assert out[("exact_match", "all")] == 0.5
    assert out[("f1", LABELS[4])] == 0.0


def test_threshold_ties_prefer_the_middle(spark):
    columns = "y int, p double"
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], columns)
    best = evaluation.tune_thresholds(df, truths=["y"], probs=["p"]).first()
    assert (best["threshold"], best["score"]) == (0.5, 1.0)
    strict = evaluation.tune_thresholds(
        df, evaluation.WIDE_GRID, prefer_middle=False, truths=["y"], probs=["p"]
    ).first()
    assert strict["threshold"] == pytest.approx(0.15)


def test_monitoring_without_optional_columns(spark):
    empty = spark.createDataFrame([], "reading_id string")
    overview = monitoring.build_overview(empty).first()
    assert (overview["readings_scored"], overview["latest_timestamp"]) == (0, None)
    assert monitoring.quality_flag_rate(empty).first()[0] == 0.0
    alerts = spark.createDataFrame([], ", ".join(f"{a} int" for a in ALERTS))
    assert monitoring.cooccurrence_gap(alerts).first()[0] == 0.0
    assert monitoring.cooccurrence_gap(alerts, None).first()[0] == 0.0


def test_snapshot_without_predictions_and_view_bounds(spark):
    rows = {r["section"]: r["document"] for r in monitoring.empty_snapshot(spark).collect()}
    assert set(rows) == {"status", "overview", "monitoring", "model"}
    assert '"status":"no_predictions"' in rows["status"]
    empty = spark.createDataFrame([], "reading_id string")
    for call in (
        lambda: monitoring.alerts_view(empty, 26),
        lambda: monitoring.dashboard_view(empty, alert_limit=21),
        lambda: monitoring.dashboard_view(empty, timeline_points=5),
    ):
        with pytest.raises(ValueError):
            call()


def test_cooccurrence_is_symmetric_with_rates_on_the_diagonal(raw):
    cells = {(r[0], r[1]): r[2] for r in monitoring.label_cooccurrence(raw).collect()}
    rates = {r[0]: r[1] for r in evaluation.label_rates(raw).collect()}
    assert all(cells[(a, b)] == cells[(b, a)] for a, b in cells)
    assert all(cells[(label, label)] == rates[label] for label in LABELS)


def test_upsert_and_history_bounds(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "reading_id string, seq int, v double")
    new = spark.createDataFrame([("a", 2, "x"), ("a", 3, "y")], "reading_id string, seq int, note string")
    merged = history.upsert(old, new, order=("seq",)).orderBy("reading_id").collect()
    assert [(r["reading_id"], r["v"], r["note"]) for r in merged] == [("a", None, "y"), ("b", 2.0, None)]
    assert history.upsert(None, old, order=("seq",)).count() == 2
    for bad in (0, 101):
        with pytest.raises(ValueError):
            history.history_tail(old, bad)
    assert history.active_predictions(old.limit(0), new) is new
    assert history.active_predictions(None, new) is new
    assert history.active_predictions(old, new) is old


def test_conform_survives_bad_cells(spark):
    text = spark.createDataFrame(
        [("r", "never", "12.5", "3.0", "x", "nan")],
        "reading_id string, timestamp string, pm25 string, hour string, aqi string, co string",
    )
    row = conform(text).first()
    assert (row["timestamp"], row["pm25"], row["hour"], row["aqi"], row["co"]) == (
        None, 12.5, 3, None, None,
    )
    assert list(row.asDict()) == list(READING_COLUMNS)


def test_thresholds_shipped():
    assert THRESHOLDS["label_industrial_event"] == 0.3
