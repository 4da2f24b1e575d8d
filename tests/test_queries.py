"""Every query against its SQL in an independent engine, cell by cell."""

import pytest
from compare import differences, duck

import __spark_entry__ as driver

QUERIES, ORACLES = driver.QUERIES, driver.ORACLES
ROWS_ONLY = {"train_and_score"}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


def test_registry_is_complete():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, sf_dir, name):
    assert differences(spark, connection, QUERIES[name], ORACLES[name], sf_dir) == []


def test_snapshot_sections(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = QUERIES["dashboard_snapshot"](spark, sf_dir).groupBy("section").agg(F.countDistinct("item")).collect()
    counts = {r["section"]: r[1] for r in rows}
    assert counts == {
        "status": 1, "overview": 1, "alerts": 8, "stations": 6, "timeline": 24, "labels": 5,
        "monitoring": 1, "model": 1,
    }


def test_entry(spark):
    result = driver.entry(spark)
    assert result.count() == 6
    assert "max_risk_prob" in result.columns


@pytest.mark.parametrize("name", ["stream_hourly", "stream_first_per_reading"])
def test_streams_are_the_same_on_part_files(spark, sf_dir, tmp_path, name, monkeypatch):
    from airsense.plans import queries

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    one = QUERIES[name](spark, sf_dir)
    folder = QUERIES[name](spark, str(tmp_path))
    assert one.exceptAll(folder).isEmpty() and folder.exceptAll(one).isEmpty() and not one.isEmpty()
    plain = queries.event_stream
    monkeypatch.setattr(queries, "event_stream", lambda s, d: plain(s, d, 1))
    single = QUERIES[name](spark, str(tmp_path))
    assert one.exceptAll(single).isEmpty() and single.exceptAll(one).isEmpty()


def test_histogram_shares_are_whole(spark, sf_dir):
    rows = QUERIES["inversion_histogram"](spark, sf_dir).groupBy("temp_inversion").agg({"share": "sum"}).collect()
    assert all(abs(r[1] - 1) < 1e-4 for r in rows)
