"""Fitted models as documents of plain numbers, and as SQL text that any engine can run.

``describe`` turns an encoder and a classifier into a document: the inputs of the feature vector in
order, and either the coefficients of a classifier chain or the nodes of the trees. ``probability_sql``
writes a document as nested expressions over the raw columns: standardised numbers, one-hot
categories, logistic curves that see the labels decided before them, trees as nested CASE.
``add_document_probabilities`` is the same model on a DataFrame.
"""

from __future__ import annotations

import math
import re

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import SQLTransformer, StringIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsense.operators.trees import GROWN, Tree, TreeModel
from airsense.schema import LABELS, PROBS

_NUMBER = re.compile(r"\(coalesce\(cast\((\w+) as double\), cast\('([^']*)' as double\)\) - cast\('([^']*)' as double\)\) / cast\('([^']*)' as double\) AS num_(\w+)")
_CATEGORY = re.compile(r"coalesce\((\w+), '((?:[^'\\]|\\.)*)'\) AS cat_(\w+)")


def encoder_inputs(encoder: PipelineModel) -> list[dict]:
    """The entries of the feature vector: numbers, then each category's values."""
    projection = next(s for s in encoder.stages if isinstance(s, SQLTransformer)).getStatement()
    inputs = [
        {"column": c, "fill": float(median), "mean": float(mean), "scale": float(scale)}
        for c, median, mean, scale, _ in _NUMBER.findall(projection)
    ]
    modes = {c: re.sub(r"\\(.)", r"\1", mode) for c, mode, _ in _CATEGORY.findall(projection)}
    for stage in encoder.stages:
        if isinstance(stage, StringIndexerModel):
            for name, values in zip(stage.getInputCols(), stage.labelsArray):
                column = name.removeprefix("cat_")
                inputs += [{"column": column, "fill": modes[column], "value": value} for value in values]
    return inputs


def describe(encoder: PipelineModel, classifier: PipelineModel | TreeModel) -> dict:
    """The document of a fitted model. Trees come whole, so this is for models of a size to read."""
    document: dict = {"inputs": encoder_inputs(encoder)}
    if isinstance(classifier, TreeModel):
        rows = classifier.trees.orderBy("tree", "label").collect()
        document["trees"] = {label: [] for label in LABELS}
        for r in rows:
            tree = Tree.unpacked(r)
            document["trees"][r["label"]].append({k: getattr(tree, k).tolist() for k in ("feature", "cut", "left", "value")})
    else:
        regressions = [s for s in classifier.stages if isinstance(s, LogisticRegressionModel)]
        document["chain"] = [
            {"label": m.getLabelCol(), "intercept": m.intercept, "coefficients": m.coefficients.toArray().tolist()} for m in regressions
        ]
    return document


# ---- as SQL ----


def _text(value: str) -> str:
    if "'" in value or "\\" in value:
        raise ValueError(f"engines do not agree on how to write {value!r}")
    return f"'{value}'"


def _double(value: float) -> str:
    if not math.isfinite(value):
        raise ValueError("a model with a number that is not finite")
    return f"CAST({value!r} AS DOUBLE)"


def input_sql(entry: dict) -> str:
    if "value" in entry:
        return f"CASE WHEN coalesce({entry['column']}, {_text(entry['fill'])}) = {_text(entry['value'])} THEN {_double(1.0)} ELSE {_double(0.0)} END"
    return f"(coalesce(CAST({entry['column']} AS DOUBLE), {_double(entry['fill'])}) - {_double(entry['mean'])}) / {_double(entry['scale'])}"


def tree_sql(tree: dict, node: int = 0) -> str:
    """A tree as nested CASE over ``x_<input>``."""
    feature = tree["feature"][node]
    if feature < 0:
        return _double(tree["value"][node])
    left = tree["left"][node]
    return f"CASE WHEN x_{feature} <= {_double(tree['cut'][node])} THEN {tree_sql(tree, left)} ELSE {tree_sql(tree, left + 1)} END"


def probability_sql(document: dict, source: str, keys: tuple[str, ...] = ("reading_id",)) -> str:
    """A query of ``keys`` and ``prob_<label>`` over the table ``source``."""
    kept = ", ".join(keys)
    inner = f"SELECT {kept}, " + ", ".join(f"{input_sql(e)} AS x_{i}" for i, e in enumerate(document["inputs"])) + f" FROM {source}"
    if "trees" in document:
        means = [
            f"({' + '.join(tree_sql(t) for t in document['trees'][label])}) / {len(document['trees'][label])} AS {prob}" for label, prob in zip(LABELS, PROBS)
        ]
        return f"SELECT {kept}, {', '.join(means)} FROM ({inner}) AS inputs"
    n = len(document["inputs"])
    earlier: list[str] = []
    for i, link in enumerate(document["chain"]):
        names = [f"x_{k}" for k in range(n)] + [f"CASE WHEN prob_{e} > 0.5 THEN 1 ELSE 0 END" for e in earlier]
        terms = [f"{_double(c)} * {x}" for c, x in zip(link["coefficients"], names, strict=True)]
        inner = f"SELECT *, 1 / (1 + exp(-({' + '.join([_double(link['intercept']), *terms])}))) AS prob_{link['label']} FROM ({inner}) AS step_{i}"
        earlier.append(link["label"])
    return f"SELECT {kept}, {', '.join(PROBS)} FROM ({inner}) AS chained"


# ---- on a DataFrame ----


def input_column(entry: dict) -> Column:
    if "value" in entry:
        return (F.coalesce(F.col(entry["column"]), F.lit(entry["fill"])) == entry["value"]).cast("double")
    return (F.coalesce(F.col(entry["column"]).cast("double"), F.lit(entry["fill"])) - entry["mean"]) / entry["scale"]


def tree_model(df: DataFrame, document: dict) -> TreeModel:
    """The trees of a document as the table that a tree model scores with."""
    rows = []
    for label, trees in document["trees"].items():
        for k, t in enumerate(trees):
            packed = [bytes(_array(t[name], code)) for name, code in (("feature", "h"), ("cut", "d"), ("left", "i"), ("value", "d"))]
            rows.append((k, label, len(t["feature"]), *[bytearray(b) for b in packed]))
    return TreeModel(df.sparkSession.createDataFrame(rows, GROWN))


def _array(values: list, code: str) -> bytes:
    from array import array

    return array(code, values).tobytes()


def add_document_probabilities(df: DataFrame, document: dict) -> DataFrame:
    """``df`` with ``prob_<label>``, scored by the document's model."""
    inputs = F.array(*[input_column(e) for e in document["inputs"]])
    if "trees" in document:
        return tree_model(df, document).add_probabilities(df.withColumn("features", array_to_vector(inputs)))
    out, decided = df.withColumn("model_inputs", inputs), []
    for link in document["chain"]:
        seen = F.concat("model_inputs", F.array(*[(F.col(f"prob_{e}") > 0.5).cast("double") for e in decided])) if decided else F.col("model_inputs")
        weighted = F.zip_with(seen, F.array(*[F.lit(c) for c in link["coefficients"]]), lambda x, c: x * c)
        margin = F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v) + link["intercept"]
        out = out.withColumn(f"prob_{link['label']}", 1 / (1 + F.exp(-margin)))
        decided.append(link["label"])
    return out.select(*df.columns, *PROBS)
