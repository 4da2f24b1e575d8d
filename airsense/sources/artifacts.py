"""JSON artifacts: metrics document, thresholds, feature list."""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airsense.schema import LABELS

_D, _S, _L = T.DoubleType(), T.StringType(), T.LongType()


def _struct(names, kind) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


LABEL_METRICS = _struct(("precision", "recall", "f1"), _D)
METRICS = _struct(
    ("hamming_loss", "f1_micro", "f1_macro", "exact_match", "jaccard_samples"), _D
).add("per_label", _struct(LABELS, LABEL_METRICS))
METRICS_DOCUMENT = (
    T.StructType()
    .add("selected_model", _S)
    .add("selected_metrics", METRICS)
    .add(
        "candidate_metrics",
        T.MapType(
            _S,
            T.StructType()
            .add("thresholds", _struct(LABELS, _D))
            .add("validation_tuned_metrics", METRICS)
            .add("test_tuned_metrics", METRICS)
            .add("validation_threshold_scores", _struct(LABELS, _D)),
        ),
    )
    .add("label_order", T.ArrayType(_S))
    .add("feature_columns", T.ArrayType(_S))
    .add("feature_count", _L)
    .add("split_rows", _struct(("train", "validation", "test"), _L))
    .add("training_label_rates", T.MapType(_S, _D))
    .add("training_label_cooccurrence", T.MapType(_S, T.MapType(_S, _D)))
    .add("trained_at_utc", _S)
)


def read_document(spark: SparkSession, path: str, schema: T.DataType) -> dict:
    """One JSON document as a dict; a missing file is an empty one, absent keys are left out."""
    try:
        row = spark.read.schema(schema).json(path, multiLine=True).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    return {} if row is None else _without_nulls(row.asDict(recursive=True))


def _without_nulls(value):
    if isinstance(value, dict):
        return {k: _without_nulls(v) for k, v in value.items() if v is not None}
    return value


def read_metrics(spark: SparkSession, path: str) -> dict:
    return read_document(spark, path, METRICS_DOCUMENT)


def read_thresholds(spark: SparkSession, path: str) -> dict:
    return read_document(spark, path, _struct(LABELS, _D))


def read_feature_columns(spark: SparkSession, path: str) -> list[str] | None:
    """The stored feature list (a JSON array of names), or None without a file."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return None if text is None else json.loads(text[0])


def write_json_rows(df: DataFrame, path: str) -> None:
    """Each row as one JSON line, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).write.mode(
        "overwrite"
    ).text(path)


def write_document(spark: SparkSession, value, path: str) -> None:
    """A small Python value as a one-line JSON file."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)
