"""Live ingest as a stream: normalise, reject, store, score, and report on change.

Every micro-batch is its own partition of each output table and is written with overwrite, so a
repeated batch after a failure replaces itself. Readers see the last write per ``reading_id``.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from airsense.operators.features import add_rolling_features
from airsense.operators.live import (
    parse_payloads, payload_rows, prepare_live_readings, rejected_payloads,
)
from airsense.operators.monitoring import build_snapshot, data_signature
from airsense.schema import ROLLED_COLUMNS, ROLLING_FEATURES
from airsense.sources.artifacts import write_json_rows
from airsense.sources.history import (
    BATCH_COLUMN, last_write_wins, read_predictions, read_table, write_batch,
)

READINGS, PREDICTIONS, REJECTED, ROLLED, TAILS, SNAPSHOT = (
    "readings", "predictions", "rejected", "rolled", "tails", "snapshot",
)
POLL = "5 seconds"


def _start(stream: DataFrame, folder: str, name: str, handle: Callable, trigger: dict | None):
    writer = stream.writeStream.foreachBatch(handle)
    writer = writer.option("checkpointLocation", f"{folder}/progress-{name}")
    return writer.trigger(**(trigger or {"processingTime": POLL})).start()


def start_ingest(
    payloads: DataFrame,
    folder: str,
    score: Callable[[DataFrame], DataFrame],
    order_column: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Stream of ``payload`` JSON texts (plus an order column) into the tables under ``folder``.

    ``score`` turns contract rows into scored rows and keeps further columns. Readings are stored before they are scored:
    generated ids and filled-in times are then the same in both tables.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = parse_payloads(batch.select(order_column, "payload")).persist()
        write_batch(rejected_payloads(parsed), f"{folder}/{REJECTED}", batch_id)
        rows = prepare_live_readings(payload_rows(parsed))
        write_batch(rows, f"{folder}/{READINGS}", batch_id)
        stored = spark.read.schema(rows.schema).parquet(
            f"{folder}/{READINGS}/{BATCH_COLUMN}={batch_id}"
        )
        newest = last_write_wins(stored, order=(order_column, "payload_position"))
        write_batch(score(newest), f"{folder}/{PREDICTIONS}", batch_id)
        parsed.unpersist()

    return _start(payloads, folder, "ingest", handle, trigger)


def current(spark: SparkSession, folder: str, name: str, order_column: str) -> DataFrame | None:
    """The table as it stands: the last write of every reading."""
    table = read_table(spark, f"{folder}/{name}")
    if table is None:
        return None
    return last_write_wins(table, order=(BATCH_COLUMN, order_column, "payload_position"))


def refresh_dashboard(
    spark: SparkSession, folder: str, order_column: str, last_signature: str | None, **options
) -> str | None:
    """Write a new snapshot when the predictions changed; return the signature to remember."""
    table = read_predictions(spark, f"{folder}/{PREDICTIONS}")
    if table is None:
        return last_signature
    signature = data_signature(table).first()[0]
    if signature != last_signature:
        # The snapshot stores what it reads of the last writes: they are picked once.
        latest = current(spark, folder, PREDICTIONS, order_column)
        shown = build_snapshot(latest, **options).withColumn("table_signature", F.lit(signature))
        write_json_rows(shown, f"{folder}/{SNAPSHOT}")
    return signature


def shown_signature(spark: SparkSession, folder: str) -> str | None:
    """The state of the predictions that the stored snapshot shows; None without a snapshot.

    It is part of the snapshot's own rows, so that both change in one write."""
    try:
        rows = spark.read.schema("table_signature string").json(f"{folder}/{SNAPSHOT}")
        found = rows.agg(F.min("table_signature")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found[0]


def start_dashboard(
    changes: DataFrame, folder: str, order_column: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """The dashboard kept up to date by a stream over the predictions table.

    ``changes`` is that table as a stream, of any columns; its rows only say that something arrived. What is
    shown is decided by the stored snapshot: a batch that adds no scored rows, and a batch repeated after
    a restart, leave it as it is.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        refresh_dashboard(spark, folder, order_column, shown_signature(spark, folder), **options)

    return _start(changes, folder, "dashboard", handle, trigger)


def start_rolling(
    readings: DataFrame, folder: str, trigger: dict | None = None
) -> StreamingQuery:
    """Rolling and lag features over a stream, continuing each station's history across batches.

    The state is a table with the last two rows per station, one version per batch; a batch is
    computed by the same (skew-safe) operator as in batch mode on the carried rows plus the new
    ones. A row older than the carried rows is marked ``late``: its history may be incomplete.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        needed = ["station_id", "timestamp", "reading_id", *ROLLED_COLUMNS]
        fresh = batch.select(*needed, F.lit(False).alias("carried"))
        tails = read_table(spark, f"{folder}/{TAILS}")
        if tails is not None:
            before = tails.where(F.col(BATCH_COLUMN) < batch_id)
            version = before.agg(F.max(BATCH_COLUMN)).first()[0]
            carried = before.where(F.col(BATCH_COLUMN) == version)
            fresh = fresh.unionByName(carried.select(*needed, F.lit(True).alias("carried")))
        fresh = fresh.persist()
        rolled = add_rolling_features(fresh)
        newest_first = Window.partitionBy("station_id").orderBy(
            F.desc("timestamp"), F.desc("reading_id")
        )
        last_two = (
            fresh.where("station_id is not null and timestamp is not null")
            .withColumn("rank", F.row_number().over(newest_first))
            .where("rank <= 2")
            .drop("rank", "carried")
        )
        write_batch(last_two, f"{folder}/{TAILS}", batch_id)
        newest_carried = (
            fresh.where("carried").groupBy("station_id").agg(F.max("timestamp").alias("carried_to"))
        )
        out = (
            rolled.where("not carried")
            .join(newest_carried, "station_id", "left")
            .withColumn(
                "late", F.coalesce(F.col("timestamp") < F.col("carried_to"), F.lit(False))
            )
            .select("reading_id", "station_id", "timestamp", *ROLLING_FEATURES, "late")
        )
        write_batch(out, f"{folder}/{ROLLED}", batch_id)
        fresh.unpersist()

    return _start(readings, folder, "rolling", handle, trigger)

