"""Reading scans and the contract every reading table is brought to."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsense.functions.numeric import nan_to_null, to_double, to_int
from airsense.schema import READING_TYPES


def _typed(df: DataFrame, name: str, wanted: T.DataType) -> Column:
    """The column of ``df`` in the wanted type; unreadable values become null, never an error."""
    column, actual = F.col(name), df.schema[name].dataType
    if isinstance(actual, T.StringType) and not isinstance(wanted, T.StringType):
        if isinstance(wanted, T.TimestampType):
            return F.try_to_timestamp(column)
        return to_int(column) if isinstance(wanted, T.IntegerType) else to_double(column)
    if isinstance(actual, (T.DoubleType, T.FloatType)):
        column = nan_to_null(column)
    return column if actual == wanted else column.try_cast(wanted)


def conform(df: DataFrame, types: dict[str, T.DataType] = READING_TYPES) -> DataFrame:
    """Exactly the contract columns, in order: absent ones null, others dropped, NaN as null."""
    return df.select(
        *[
            (_typed(df, name, wanted) if name in df.columns else F.lit(None).cast(wanted)).alias(name)
            for name, wanted in types.items()
        ]
    )


def read_readings(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Scan raw readings. CSV cells are read as text and converted one by one, so a malformed
    cell costs that cell only; Parquet and ORC keep column pruning and filter pushdown."""
    if fmt == "csv":
        return conform(spark.read.option("header", True).csv(path))
    return conform(spark.read.format(fmt).load(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=()) -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(
            header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    writer.partitionBy(*partition_by).save(path)
