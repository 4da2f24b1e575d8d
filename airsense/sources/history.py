"""Prediction history: append, tail, keyed upsert and the choice of the active source."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from airsense.operators.scoring import backfill_summary

MAX_TAIL = 100
BATCH_COLUMN = "ingest_batch"
WRITE_ORDER = (BATCH_COLUMN, "payload_position")


def append_history(df: DataFrame, path: str) -> None:
    """Add rows at a cost of the new rows only. Types are kept, signatures stay text."""
    df.write.mode("append").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch as its own partition; repeating the batch replaces it."""
    df.drop(BATCH_COLUMN).write.mode("overwrite").parquet(f"{path}/{BATCH_COLUMN}={batch_id}")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_predictions(spark: SparkSession, path: str) -> DataFrame | None:
    table = read_table(spark, path)
    return None if table is None else backfill_summary(table)


def history_tail(df: DataFrame, limit: int = 20) -> DataFrame:
    """The last ``limit`` (1 to 100) rows by scoring time, then id."""
    if not 1 <= limit <= MAX_TAIL:
        raise ValueError(f"limit must be between 1 and {MAX_TAIL}")
    return df.orderBy(F.desc("scored_at"), F.desc("reading_id")).limit(limit)


def last_write_wins(
    df: DataFrame, key: Sequence[str] = ("reading_id",), order: Sequence[str] = WRITE_ORDER
) -> DataFrame:
    """One row per key: the last one in write order.

    The rank limit also runs before the shuffle, so a key that was written very often costs one
    row per task.
    """
    newest_first = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return (
        df.withColumn("recency", F.row_number().over(newest_first))
        .where("recency = 1")
        .drop("recency")
    )


def upsert(
    existing: DataFrame | None,
    rows: DataFrame,
    key: Sequence[str] = ("reading_id",),
    order: Sequence[str] = WRITE_ORDER,
) -> DataFrame:
    """Existing and new rows merged by key; columns only one side has become null on the other."""
    merged = rows if existing is None else existing.unionByName(rows, allowMissingColumns=True)
    return last_write_wins(merged, key, order)


def active_predictions(live: DataFrame | None, batch: DataFrame | None) -> DataFrame | None:
    """Live predictions when there are any, else the batch ones."""
    return live if live is not None and not live.isEmpty() else batch
