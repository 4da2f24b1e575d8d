"""The first row of every reading, whatever the order of files and batches."""

import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver


@pytest.mark.parametrize("newest_first", [False, True])
def test_a_year_of_readings_in_any_file_order(spark, sf_dir, tmp_path, monkeypatch, newest_first):
    from airsense.plans import queries

    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 700")
    months = [events.withColumns({"ts": F.expr(f"ts + interval {m} months"), "event_id": F.expr(f"event_id + {m * 700}")}) for m in range(0, 12, 3)]
    # each file also replays readings of the first month, a day later
    replays = events.where("event_id < 20").withColumn("ts", F.expr("ts + interval 1 day"))
    for month in reversed(months) if newest_first else months:
        month.union(replays).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(0.05)
    plain = queries.event_stream
    monkeypatch.setattr(queries, "event_stream", lambda s, d: plain(s, d, 1))
    rows = driver.QUERIES["stream_first_per_reading"](spark, str(tmp_path)).collect()
    got = {r.reading_id: r.timestamp for r in rows}
    every = months[0].union(months[1]).union(months[2]).union(months[3])
    expected = {str(r.event_id): r.hour for r in every.select("event_id", F.date_trunc("hour", "ts").alias("hour")).collect()}
    assert len(rows) == len(got) and got == expected
