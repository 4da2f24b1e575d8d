"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from airsense.operators import clean, features, monitoring
from airsense.sources.driver_tables import add_fixture_scores
from airsense.sources.stored import Lookup, as_lookup, store
from plan_text import plan_of



def wide_exchanges(df) -> int:
    """Shuffles that carry a column that only whole readings have."""
    exchanges = [part.split("\n\n")[0] for part in plan_of(df).split(") Exchange\n")[1:]]
    assert exchanges
    return sum("pressure_hpa" in e for e in exchanges)


NARROW = (
    "problem_rows", "aqi_reference", "clean_categories", "missing_flags", "sensor_quality_flags",
    "repair_pm10", "features_circular", "features_composite", "features_weather", "features_risk",
    "live_normalise", "live_reject", "payload_defaults", "temporal_columns", "season_from_month",
    "score_alerts", "score_summary", "predictions_backfill", "ingest_response",
)
LAZY = NARROW + (
    "validation_counts", "missing_profile", "duplicate_groups", "dedupe_first", "upsert_last_wins",
    "overview", "recent_alerts", "timeline", "label_drift", "cooccurrence_gap",
    "threshold_tuning", "multilabel_metrics", "season_hour_pivot", "label_cardinality",
)


@pytest.mark.parametrize("name", NARROW)
def test_row_wise_queries_do_not_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan_of(driver.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", LAZY)
def test_no_python_workers_and_no_cross_products(spark, sf_dir, name):
    plan = plan_of(driver.queries()[name](spark, sf_dir))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_windows_are_partitioned(spark, raw):
    plan = plan_of(features.add_rolling_features(raw, 100))
    windows = re.findall(r"\) Window\n.*?Arguments: .*?\], \[(.*?)\]", plan, re.S)
    assert windows and all("station_id" in w for w in windows)
    assert "SinglePartition" not in plan


def test_ten_rolling_columns_share_one_shuffle(raw):
    """The rows move once; the carried rows of the chunks are few columns."""
    assert wide_exchanges(features.add_rolling_features(raw)) == 1


def test_dedupe_is_one_partially_aggregated_shuffle(raw):
    plan = plan_of(clean.drop_sensor_duplicates(raw))
    assert len(re.findall(r"\(\d+\) Exchange", plan)) == 1
    assert "partial_min" in plan


def test_imputation_with_known_medians_adds_no_shuffle(raw):
    fills = clean.fit_fill_values(raw)
    plan = plan_of(clean.impute(clean.clean_rows(raw), fills))
    assert plan.count("BroadcastHashJoin") >= 2
    assert not re.findall(r"\(\d+\) Exchange", plan)


def test_scans_read_only_what_is_needed(raw):
    scored = store(add_fixture_scores(clean.clean_rows(raw)), "scored")
    plan = plan_of(monitoring.build_recent_alerts(scored))
    assert "TakeOrderedAndProject" in plan
    assert "GreaterThan(total_alerts,0)" in plan
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "humidity_pct" not in schema and "co:" not in schema.split(",")
    overview = re.search(r"ReadSchema: struct<(.*?)>", plan_of(monitoring.build_overview(scored)))
    assert len(overview.group(1).split(",")) == 6


def test_lookup_is_broadcast_only_after_its_size_was_checked(spark):
    small = as_lookup(spark.range(50), "small", max_rows=100)
    large = as_lookup(spark.range(500), "large", max_rows=100)
    assert (small.small, large.small) == (True, False)
    assert large.table.count() == 500
    big = spark.range(1000)
    hint = plan_of(big.join(small.side(), "id"))
    assert "BroadcastHashJoin" in hint
    assert isinstance(small, Lookup) and "ResolvedHint" not in plan_of(large.side())


def test_timeline_filters_the_scan(raw):
    scored = store(add_fixture_scores(clean.clean_rows(raw)), "scored")
    plan = plan_of(monitoring.build_timeline(scored))
    assert "Subquery" in plan
    assert re.search(r"PushedFilters: \[.*timestamp", plan)
    assert monitoring.build_timeline(scored).agg(F.count("*")).first()[0] == 24


def test_duplicates_move_wide_rows_once_at_most(raw):
    """Counts shuffle a digest and an id, never the columns of a reading."""
    from airsense.operators import quality

    assert wide_exchanges(quality.duplicate_counts(raw)) == 0
    assert "SortMergeJoin" not in plan_of(quality.duplicate_groups(raw))


def test_rows_of_single_digests_are_never_shuffled(spark, raw, monkeypatch):
    """Few groups: no shuffle of rows. Many: only rows that a bitmap lets pass."""
    from airsense.operators import quality
    from airsense.sources import stored

    few = quality.duplicate_groups(raw)
    assert not re.findall(r"\(\d+\) Exchange", plan_of(few))
    monkeypatch.setattr(stored, "SMALL_TABLE_ROWS", 1)
    many = quality.duplicate_groups(raw)
    assert wide_exchanges(many) <= 1 and "bitmap_construct_agg" in plan_of(many)
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty() and not few.isEmpty()


@pytest.mark.parametrize("bits", [16, 1])
def test_bitmap_keeps_every_wanted_row(spark, monkeypatch, bits):
    from airsense.operators import quality

    monkeypatch.setattr(quality, "BITS_PER_DIGEST", bits)
    rows = spark.range(40_000).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    wanted = rows.where("id % 9 = 0").select("digest")
    passed = quality.maybe_in(rows, wanted, 4445)
    assert passed.columns == rows.columns and passed.where("id % 9 = 0").count() == 4445
    assert passed.count() < (4445 + 35_555 / 8 if bits == 16 else 40_000)
