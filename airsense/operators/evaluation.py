"""Splits, multi-label metrics, threshold tuning and model selection as aggregations."""

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsense.functions.numeric import flag, rnd, total
from airsense.operators.ordered import ROWS_PER_CHUNK, order_key, rows_at
from airsense.operators.quantiles import exact_quantiles
from airsense.schema import ALERTS, LABELS, PROBS
from airsense.sources.stored import as_lookup

# ---- fixed values ----
TEST_SHARE = 0.2
VALIDATION_SHARE = 0.1
VALIDATION_MINIMUM = 25 * len(LABELS)
TUNING_GRID = tuple(0.2 + i * 0.05 for i in range(13))
WIDE_GRID = tuple(0.1 + i * 0.05 for i in range(16))
DEFAULT_THRESHOLD = 0.5
CLOSE_RELATIVE, CLOSE_ABSOLUTE = 1e-5, 1e-8
# ---- end of fixed values ----

SPLIT_ORDER = ("timestamp", "station_id", "reading_id")


def split_sizes(
    rows: int,
    test_share: float = TEST_SHARE,
    validation_share: float = VALIDATION_SHARE,
    validation_minimum: int = VALIDATION_MINIMUM,
) -> tuple[int, int]:
    """Ranks at which validation and test start in time order."""
    test_start = int(rows * (1 - test_share))
    validation = max(int(rows * validation_share), validation_minimum)
    return max(test_start - validation, 0), test_start


def time_split(
    df: DataFrame,
    test_share: float = TEST_SHARE,
    validation_share: float = VALIDATION_SHARE,
    validation_minimum: int = VALIDATION_MINIMUM,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``split``: train, then validation, then test along (time, station, id).

    Only the two boundary keys are looked up; labelling a row is a comparison with them, so no row
    is sorted or moved, and any number of rows may share a timestamp.
    """
    key = order_key(*SPLIT_ORDER)
    rows = df.count()
    starts = split_sizes(rows, test_share, validation_share, validation_minimum)
    bounds = rows_at(df, SPLIT_ORDER, starts, rows_per_chunk)

    def before(bound) -> Column:
        return F.lit(True) if bound is None else key < _literal_key(bound)

    return df.withColumn(
        "split",
        F.when(before(bounds[0]), F.lit("train"))
        .when(before(bounds[1]), F.lit("validation"))
        .otherwise(F.lit("test")),
    )


def _literal_key(bound) -> Column:
    types = dict(zip(SPLIT_ORDER, ("timestamp", "string", "string")))
    parts = []
    for name in SPLIT_ORDER:
        parts.append(F.lit(bound[f"{name}_unknown"]).alias(f"{name}_unknown"))
        parts.append(F.lit(bound[name]).cast(types[name]).alias(name))
    return F.struct(*parts)


def evaluate_multilabel(
    df: DataFrame, truths: Sequence[str] = LABELS, predictions: Sequence[str] = ALERTS
) -> DataFrame:
    """``metric, label, value`` from one pass of counts; undefined ratios are 0.

    The per-row overlap ratio has a denominator of at most the label count, so it is summed as an
    exact whole number over a common denominator.
    """
    common = math.lcm(*range(1, len(truths) + 1))
    pairs = list(zip(truths, predictions))
    both = total(flag((F.col(t) == 1) & (F.col(p) == 1)) for t, p in pairs)
    either = total(flag((F.col(t) == 1) | (F.col(p) == 1)) for t, p in pairs)
    overlap = F.coalesce((both * common / F.nullif(either, F.lit(0))), F.lit(0.0)).cast("bigint")
    wrong = total(flag(F.col(t) != F.col(p)) for t, p in pairs)

    aggregates = [
        F.count("*").alias("rows"),
        F.sum(wrong).alias("wrong"),
        F.count_if(wrong == 0).alias("exact"),
        F.sum(overlap).alias("overlap"),
    ]
    for i, (t, p) in enumerate(pairs):
        aggregates += [
            F.count_if((F.col(t) == 1) & (F.col(p) == 1)).alias(f"tp_{i}"),
            F.count_if((F.col(t) != 1) & (F.col(p) == 1)).alias(f"fp_{i}"),
            F.count_if((F.col(t) == 1) & (F.col(p) != 1)).alias(f"fn_{i}"),
        ]

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))

    def f1(tp: Column, fp: Column, fn: Column) -> Column:
        return ratio(2 * tp, 2 * tp + fp + fn)

    count = [tuple(F.col(f"{kind}_{i}") for kind in ("tp", "fp", "fn")) for i in range(len(pairs))]
    sums = [total(c[k] for c in count) for k in range(3)]
    rows = F.col("rows")
    values = {
        ("hamming_loss", "all"): ratio(F.col("wrong"), rows * len(pairs)),
        ("f1_micro", "all"): f1(*sums),
        ("f1_macro", "all"): total(f1(*c) for c in count) / len(pairs),
        ("exact_match", "all"): ratio(F.col("exact"), rows),
        ("jaccard_samples", "all"): ratio(F.col("overlap"), rows * common),
    }
    for (tp, fp, fn), label in zip(count, truths):
        values[("precision", label)] = ratio(tp, tp + fp)
        values[("recall", label)] = ratio(tp, tp + fn)
        values[("f1", label)] = f1(tp, fp, fn)
    return df.agg(*aggregates).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(metric).alias("metric"), F.lit(label).alias("label"), v.alias("value")
                    )
                    for (metric, label), v in values.items()
                ]
            )
        )
    )


def threshold_curve(
    df: DataFrame,
    grid: Sequence[float] = TUNING_GRID,
    truths: Sequence[str] = LABELS,
    probs: Sequence[str] = PROBS,
) -> DataFrame:
    """``label, step, threshold, tp, fp, fn, f1`` for every label and grid threshold.

    A row only needs the number of thresholds it passes, so each row adds one counter per label
    (not one per label and threshold); the rest is arithmetic on those few counters.
    """
    thresholds = F.array(*[F.lit(float(t)) for t in grid])
    passes = [
        F.struct(
            F.lit(label).alias("label"),
            F.coalesce(F.col(label), F.lit(0)).alias("truth"),
            total(flag(F.col(prob) >= F.lit(float(t))) for t in grid).alias("passed"),
        )
        for label, prob in zip(truths, probs)
    ]
    counters = (
        df.select(F.inline(F.array(*passes)))
        .groupBy("label", "passed")
        .agg(F.sum("truth").alias("positive"), F.sum(1 - F.col("truth")).alias("negative"))
    )
    per_label = counters.groupBy("label").agg(
        F.collect_list(F.struct("passed", "positive", "negative")).alias("counters")
    )

    def sum_above(field: str, step: Column) -> Column:
        above = F.filter("counters", lambda c: c["passed"] > step)
        return F.aggregate(above, F.lit(0).cast("bigint"), lambda acc, c: acc + c[field])

    points = F.transform(
        thresholds,
        lambda threshold, step: F.struct(
            step.alias("step"),
            threshold.alias("threshold"),
            sum_above("positive", step).alias("tp"),
            sum_above("negative", step).alias("fp"),
            (sum_above("positive", F.lit(-1)) - sum_above("positive", step)).alias("fn"),
        ),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per_label.select("label", F.inline(points)).withColumn(
        "f1", F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))
    )


def tune_thresholds(
    df: DataFrame,
    grid: Sequence[float] = TUNING_GRID,
    prefer_middle: bool = True,
    truths: Sequence[str] = LABELS,
    probs: Sequence[str] = PROBS,
) -> DataFrame:
    """Best threshold per label, scanning the grid upwards: ``label, threshold, score``.

    With ``prefer_middle`` a practically equal score wins if its threshold is closer to 0.5, and
    the kept threshold is rounded to two digits; without, only a strictly better score wins.
    """
    curve = threshold_curve(df, grid, truths, probs)
    scan = F.array_sort(F.collect_list(F.struct("step", "threshold", "f1")))

    def keep(best: Column, point: Column) -> Column:
        better = point["f1"] > best["score"]
        threshold = point["threshold"]
        if prefer_middle:
            near = F.abs(point["f1"] - best["score"]) <= CLOSE_ABSOLUTE + CLOSE_RELATIVE * F.abs(
                best["score"]
            )
            closer = F.abs(threshold - DEFAULT_THRESHOLD) < F.abs(
                best["threshold"] - DEFAULT_THRESHOLD
            )
            better = better | (near & closer)
            threshold = rnd(threshold, 2)
        taken = F.struct(threshold.alias("threshold"), point["f1"].alias("score"))
        return F.when(better, taken).otherwise(best)

    start = F.struct(
        F.lit(DEFAULT_THRESHOLD).alias("threshold"), F.lit(-1.0).alias("score")
    )
    return (
        curve.groupBy("label")
        .agg(F.aggregate(scan, start, keep).alias("best"))
        .select("label", "best.threshold", rnd(F.col("best.score"), 4).alias("score"))
    )


def label_rates(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    rates = df.agg(*[F.avg(label).alias(label) for label in labels])
    return rates.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(label).alias("label"), rnd(F.col(label), 4).alias("rate"))
                    for label in labels
                ]
            )
        )
    )


def class_weights(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Balanced weight of each class: rows / (2 × rows of the class)."""
    counted = df.agg(
        F.count("*").alias("rows"), *[F.sum(label).cast("bigint").alias(label) for label in labels]
    )
    entries = []
    for label in labels:
        for value, size in ((1, F.col(label)), (0, F.col("rows") - F.col(label))):
            entries.append(
                F.struct(
                    F.lit(label).alias("label"),
                    F.lit(value).alias("class_value"),
                    size.alias("class_rows"),
                    (F.col("rows") / F.nullif(2 * size, F.lit(0))).alias("weight"),
                )
            )
    return counted.select(F.inline(F.array(*entries)))


def select_model(metrics: DataFrame) -> DataFrame:
    """Best of ``model, hamming_loss, f1_macro, exact_match, f1_micro`` rows."""
    return metrics.orderBy(
        F.asc("hamming_loss"), F.desc("f1_macro"), F.desc("exact_match"), F.desc("f1_micro"),
        F.asc("model"),
    ).limit(1)


def headline_metrics(metrics: DataFrame, model: str) -> DataFrame:
    """The overall metrics of one candidate as one row."""
    names = ("hamming_loss", "f1_micro", "f1_macro", "exact_match", "jaccard_samples")
    return metrics.where("label = 'all'").agg(
        F.first(F.lit(model)).alias("model"),
        *[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names],
    )


def per_label_f1(metrics: Mapping[str, DataFrame]) -> DataFrame:
    """One row per label, one column per candidate."""
    scores = [
        rows.where("metric = 'f1'").select("label", F.lit(model).alias("model"), "value")
        for model, rows in metrics.items()
    ]
    return (
        reduce(DataFrame.unionByName, scores)
        .groupBy("label")
        .pivot("model", list(metrics))
        .agg(F.max("value"))
    )


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, median, mean, scale`` with mean and population deviation after filling nulls
    by the median; a constant column gets scale 1. A column without any value counts as 0."""
    medians = exact_quantiles(df, (), columns, (0.5,)).select(
        "column_name", F.col("quantile").alias("found")
    )
    known = as_lookup(medians, "column-medians")
    counted = df.agg(
        F.count("*").alias("rows"),
        *[
            f(F.col(c).cast("double")).alias(f"{name}_{c}")
            for c in columns
            for name, f in (
                ("n", F.count), ("avg", F.avg), ("var", F.var_pop), ("low", F.min), ("high", F.max),
            )
        ],
    )
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("rows"),
            *[F.coalesce(f"{x}_{c}", F.lit(0.0)).alias(x) for x in ("n", "avg", "var", "low", "high")],
        )
        for c in columns
    ]
    # The filled column is the known values and (rows - n) copies of the median, put together.
    n, rows, median = F.col("n"), F.col("rows"), F.col("median")
    spread = n * F.col("var") + n * (F.col("avg") - F.col("mean")) ** 2 + (rows - n) * (median - F.col("mean")) ** 2
    return (
        counted.where("rows > 0")
        .select(F.inline(F.array(*per_column)))
        .join(known.side(), "column_name", "left")
        .withColumn("median", F.coalesce("found", F.lit(0.0)))
        .withColumn("mean", (n * F.col("avg") + (rows - n) * median) / rows)
        .withColumn("deviation", F.sqrt(spread / rows))
        .select(
            "column_name",
            "median",
            "mean",
            # Decided by the extremes: sums leave a trace of rounding in a constant column.
            F.when(F.col("low") < F.col("high"), F.col("deviation")).otherwise(F.lit(1.0)).alias("scale"),
        )
    )


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, value, rows``: the most frequent value; the smallest one among equals."""
    counts = (
        df.select(*columns)
        .unpivot([], list(columns), "column_name", "value")
        .where("value is not null")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("rows"))
    )
    return counts.groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("rows"), F.col("value"))).alias("value"),
        F.max("rows").alias("rows"),
    )

