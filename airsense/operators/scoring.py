"""From five probabilities to alerts and row-level summary columns.

Scores are computed on the row they belong to, so no positional alignment is ever needed.
"""

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsense.functions.numeric import flag, rnd, total
from airsense.schema import ALERTS, FEATURE_COLUMNS, LABELS, PROBS


def add_alerts(df: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """``alert_<risk>`` = probability at or above the label's threshold."""
    return df.withColumns(
        {
            alert: flag(F.col(prob) >= F.lit(float(thresholds[label])))
            for label, prob, alert in zip(LABELS, PROBS, ALERTS)
        }
    )


def max_risk_prob(probs=PROBS) -> Column:
    return rnd(F.greatest(*probs) if len(probs) > 1 else F.col(probs[0]), 4)


def dominant_risk(probs=PROBS) -> Column:
    """Name of the largest probability; the first label in order wins a tie."""
    top = F.greatest(*probs) if len(probs) > 1 else F.col(probs[0])
    return F.coalesce(
        *[F.when(F.col(prob) == top, F.lit(prob.removeprefix("prob_label_"))) for prob in probs]
    )


def alert_signature(alerts=ALERTS) -> Column:
    """Bit string in label order; always text, so leading zeros stay."""
    return F.concat(*[F.col(alert).cast("string") for alert in alerts])


def add_score_summary(
    df: DataFrame, scored_at: Column | None = None, model_version: str = "unknown"
) -> DataFrame:
    return df.withColumns(
        {
            "total_alerts": total(F.col(alert) for alert in ALERTS),
            "max_risk_prob": max_risk_prob(),
            "dominant_risk": dominant_risk(),
            "alert_signature": alert_signature(),
            "scored_at": F.current_timestamp() if scored_at is None else scored_at,
            "model_version": F.lit(model_version),
        }
    )


def backfill_summary(df: DataFrame) -> DataFrame:
    """Add the summary columns an older predictions table lacks; present ones stay as they are."""
    probs = [p for p in PROBS if p in df.columns]
    alerts = [a for a in ALERTS if a in df.columns]
    derived = {}
    if probs:
        derived["max_risk_prob"] = max_risk_prob(probs)
        derived["dominant_risk"] = dominant_risk(probs)
    if alerts:
        derived["alert_signature"] = alert_signature(alerts)
    return df.withColumns({name: c for name, c in derived.items() if name not in df.columns})


def resolve_feature_columns(
    available: list[str],
    fitted: list[str] | None = None,
    artifact: list[str] | None = None,
    metadata: list[str] | None = None,
) -> list[str]:
    """Which columns feed the model: what it was fitted on, else the stored list, else the list in
    the metrics document, else everything; ids and labels never."""
    chosen = fitted or artifact or metadata or available
    excluded = {"reading_id", "timestamp", *LABELS}
    return [c for c in chosen if c not in excluded]


def align_features(df: DataFrame, columns=FEATURE_COLUMNS) -> DataFrame:
    """Add absent model inputs as null; the fitted imputer fills them."""
    absent = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else df


def score(
    clean: DataFrame,
    add_features: Callable[[DataFrame], DataFrame],
    add_probabilities: Callable[[DataFrame], DataFrame],
    thresholds: Mapping[str, float],
    model_version: str = "unknown",
    scored_at: Column | None = None,
) -> DataFrame:
    """Clean rows in, the same rows with probabilities, alerts and summary out."""
    scored = add_alerts(add_probabilities(add_features(clean)), thresholds)
    scored = add_score_summary(scored, scored_at, model_version)
    return scored.select(
        *clean.columns, *PROBS, *ALERTS,
        "total_alerts", "max_risk_prob", "dominant_risk", "alert_signature",
        "scored_at", "model_version",
    )


def ingest_response(scored: DataFrame) -> DataFrame:
    return scored.select("reading_id", "station_id", "total_alerts", "max_risk_prob", "dominant_risk")


def batch_response(scored: DataFrame) -> DataFrame:
    return scored.select(*ingest_response(scored).columns, "scored_at")
