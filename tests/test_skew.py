"""Large-group code paths on small data: a hot key, hot timestamps, many chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airsense.operators import clean, eda, evaluation, features, monitoring, quality
from airsense.operators.ordered import order_key, rows_at, with_chunks
from airsense.operators.quantiles import exact_quantiles
from airsense.schema import ROLLING_FEATURES
from airsense.sources import stored
from airsense.sources.driver_tables import add_fixture_scores
from airsense.sources.history import last_write_wins
from airsense.sources.stored import store
from plan_text import plan_of


@pytest.fixture(scope="module")
def hot(spark):
    """One station holds most rows and one timestamp of it a third of all rows."""
    rows = spark.range(6000).select(
        F.format_string("R%05d", (F.col("id") * 7919) % 6000).alias("reading_id"),
        F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("station_id"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-05 00:00:00").cast("timestamp"))
        .when(F.col("id") % 101 == 0, F.lit(None).cast("timestamp"))
        .otherwise(F.timestamp_seconds(1704067200 + (F.col("id") * 37 % 500) * 3600))
        .alias("timestamp"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 13 % 997) / 10).alias("pm25"),
        ((F.col("id") * 17 % 883) / 10).alias("no2"),
        (F.col("id") * 29 % 401).cast("int").alias("aqi"),
    )
    return rows.repartition(6).persist()


@pytest.mark.parametrize("rows_per_chunk", [40, 350, 2500])
def test_chunked_rolling_equals_one_window(hot, rows_per_chunk):
    columns = ["reading_id", *ROLLING_FEATURES]
    whole = features.add_rolling_features(hot).select(columns)
    cut = features.add_rolling_features(hot, rows_per_chunk).select(columns)
    assert cut.count() == whole.count()
    assert cut.exceptAll(whole).isEmpty()


@pytest.mark.parametrize("rows_per_chunk", [30, 400, 1_000_000])
def test_rolling_equals_pandas(hot, rows_per_chunk):
    pdf = hot.toPandas().sort_values(["station_id", "timestamp", "reading_id"], na_position="last")
    grouped = pdf.groupby("station_id")
    expected = dict(zip(pdf["reading_id"], grouped["no2"].transform(lambda v: v.rolling(3, min_periods=1).mean())))
    lagged = dict(zip(pdf["reading_id"], grouped["no2"].shift(1)))
    for r in features.add_rolling_features(hot, rows_per_chunk).collect():
        assert r["no2_roll3_mean"] == pytest.approx(expected[r["reading_id"]], abs=0.00501)
        if r["no2_lag1"] is None:
            assert np.isnan(lagged[r["reading_id"]])
        else:
            assert r["no2_lag1"] == lagged[r["reading_id"]]


def test_chunks_are_small_and_runs_of_neighbours(hot):
    placed = with_chunks(hot, ["station_id"], ["timestamp", "reading_id"], 300)
    assert placed.count() == hot.count()
    assert max(r["count"] for r in placed.groupBy("station_id", "chunk").count().collect()) <= 300
    key = order_key("station_id", "timestamp", "reading_id")
    along = [(r["station_id"], r["chunk"]) for r in placed.orderBy(key).collect()]
    starts = [a for a, b in zip(along, [None, *along]) if a != b]
    assert len(starts) == len(set(starts))


def test_copies_of_one_key_end_the_splitting(spark):
    rows = spark.range(50).selectExpr(
        "'R1' AS reading_id", "'s' AS station_id", "timestamp '2024-01-05' AS timestamp", "id * 1.0 AS pm25",
        "id * 1.0 AS no2", "1 AS aqi",
    )
    assert features.add_rolling_features(rows, 10).count() == 50
    key = rows_at(rows, ["timestamp", "station_id", "reading_id"], (0, 49, 50), 10)
    assert [k and k["reading_id"] for k in key] == ["R1", "R1", None]
    assert features.add_rolling_features(rows.limit(0)).count() == 0
    assert rows_at(rows.limit(0), ["timestamp", "station_id", "reading_id"], (0, 1)) == [None, None]


def test_rows_at_any_rank(hot):
    key = order_key("timestamp", "station_id", "reading_id")
    ordered = [r[0] for r in hot.select(key.alias("k")).orderBy("k").collect()]
    ranks = (0, 1, 2999, 4321, 5999, 6000)
    for rows_per_chunk in (10_000, 250):
        found = rows_at(hot, ["timestamp", "station_id", "reading_id"], ranks, rows_per_chunk)
        assert [None if f is None else tuple(f) for f in found] == [
            tuple(ordered[r]) if r < 6000 else None for r in ranks
        ]


def test_split_with_tied_times(hot):
    for rows_per_chunk in (10_000, 250):
        split = evaluation.time_split(hot, rows_per_chunk=rows_per_chunk)
        sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
        assert sizes == {"train": 4200, "validation": 600, "test": 1200}


@pytest.mark.parametrize("accuracy", [200, 1000, 10_000])
def test_quantiles_are_exact_beyond_the_sketch(spark, accuracy):
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise("other").alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("spread"),
        F.when(F.col("id") % 10 < 4, 5.0).otherwise(F.col("id") % 50).alias("lumpy"),
    )
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    found = exact_quantiles(df, ("g",), ("spread", "lumpy"), probs, accuracy).collect()
    assert len(found) == 20
    pdf = df.toPandas()
    for r in found:
        values = pdf.loc[pdf["g"] == r["g"], r["column_name"]]
        assert r["n"] == len(values)
        assert r["quantile"] == pytest.approx(np.quantile(values, r["prob"]), rel=1e-12)


def test_large_groups_get_a_finer_sketch(spark):
    df = spark.range(50_000).select((F.pmod(F.xxhash64("id"), F.lit(99_991)) / 3).alias("v"))
    found = exact_quantiles(df, (), ("v",), (0.5,), accuracy=100, bracket_cells=600).first()
    assert found["quantile"] == pytest.approx(np.median(df.toPandas()["v"]), rel=1e-12)


def test_stats_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame(
        [(0.1, None, 1.0), (0.1, None, None), (None, None, 4.0)] * 7, "same double, none double, some double"
    )
    found = {r["column_name"]: r for r in evaluation.numeric_stats(df, df.columns).collect()}
    assert (found["same"]["scale"], found["none"]["scale"], found["none"]["median"]) == (1.0, 1.0, 0.0)
    filled = df.toPandas()["some"].fillna(2.5)
    assert found["some"]["mean"] == pytest.approx(filled.mean())
    assert found["some"]["scale"] == pytest.approx(filled.std(ddof=0))


def test_quantiles_skip_nulls_and_unknown_groups(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", 4.0), ("b", None), (None, 9.0)], "g string, v double"
    )
    assert [tuple(r) for r in exact_quantiles(df, ("g",), ("v",), (0.5,)).collect()] == [
        ("a", "v", 0.5, 2, 2.5)
    ]


def test_a_third_of_all_rows_are_copies(raw):
    one = raw.orderBy("reading_id").limit(1)
    copies = one.crossJoin(raw.sparkSession.range(500)).select(
        F.concat(F.lit("COPY"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("reading_id"),
        *[c for c in raw.columns if c != "reading_id"],
    )
    rows = store(raw.unionByName(copies).repartition(5), "copies")
    before = quality.duplicate_counts(raw).first()
    after = quality.duplicate_counts(rows).first()
    assert after["total_rows"] == before["total_rows"] + 500
    assert (
        after["duplicates_excluding_reading_id"]
        == before["duplicates_excluding_reading_id"] + 500
    )
    kept = clean.drop_sensor_duplicates(rows)
    assert kept.count() == clean.drop_sensor_duplicates(raw).count()
    assert kept.where("reading_id like 'COPY%'").count() == 1
    assert quality.duplicate_groups(rows).agg(F.max("group_size")).first()[0] >= 501


def test_results_are_the_same_beyond_the_broadcast_limit(monkeypatch, raw):
    """With a limit of two rows every lookup becomes a stored table and a shuffle join."""
    scored = add_fixture_scores(clean.clean_rows(raw))

    def results():
        titled = eda.title_categories(raw)
        numbers = evaluation.numeric_stats(raw, ["pm25", "benzene", "aqi"])
        return [
            sorted(map(str, df.collect()))
            for df in (
                clean.preprocess(raw),
                eda.pollutant_quartiles(titled),
                monitoring.build_station_summary(scored),
                numbers.select("column_name", "median", F.round("mean", 9)),
            )
        ]

    usual = results()
    monkeypatch.setattr(stored, "SMALL_TABLE_ROWS", 2)
    assert results() == usual


def test_rank_limits_run_before_the_shuffle(spark, hot):
    keyed = hot.withColumn("seq", F.col("aqi"))
    plan = plan_of(last_write_wins(keyed, ("station_id",), ("seq",)))
    assert plan.count("WindowGroupLimit") >= 2
