"""Intermediate tables in the shared folder, and size-checked small tables.

A result that several passes read is written once as Parquet to the folder named by
``spark.checkpoint.dir``. That cuts the lineage (a lost executor re-reads files instead of
recomputing a wide shuffle) and, unlike a row-based checkpoint, lets every later pass read only
the columns it needs.
"""

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SMALL_TABLE_ROWS = 10_000

#: Where stored tables go in local mode if ``spark.checkpoint.dir`` is unset.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/airsense/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{LOCAL_FOLDER}/airsense/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def store(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once, with ``options`` of the Parquet writer, and return the table that reads it back."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Lookup:
    """A lookup table together with the outcome of its size check; its rows when it is small."""

    table: DataFrame
    rows: tuple[Row, ...] | None

    @property
    def small(self) -> bool:
        return self.rows is not None

    def side(self) -> DataFrame:
        """Broadcast when the check passed; otherwise a plain side that joins by shuffle, where
        adaptive execution splits skewed partitions of the large side."""
        return F.broadcast(self.table) if self.small else self.table


def as_lookup(df: DataFrame, name: str, max_rows: int | None = None) -> Lookup:
    """Run ``df`` once. At most ``max_rows`` rows: a local relation. More: a stored table."""
    max_rows = SMALL_TABLE_ROWS if max_rows is None else max_rows
    rows = df.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return Lookup(df.sparkSession.createDataFrame(rows, df.schema), tuple(rows))
    return Lookup(store(df, name), None)
