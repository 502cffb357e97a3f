"""The fixed eight-feature alpha model, its accuracy report and trading rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.definitions import ALPHA_CUTS, ALPHA_MARKET_BASELINE, ALPHA_MODEL


def alpha_features(df: DataFrame) -> DataFrame:
    """The eight inputs from company, filing and activity columns; training means fill gaps."""
    mean = {f: F.lit(m) for f, (_, m, _) in ALPHA_MODEL.items()}
    price, low, high, target = (F.col(c) for c in ("current_price", "low_52w", "high_52w", "target_price"))
    upside = F.when((target != 0) & (price > 0), (target / price - 1) * 100)
    return df.withColumns({
        "price_to_low": F.coalesce(F.when(low > 0, price / low), mean["price_to_low"]),
        "price_to_high": F.coalesce(F.when(high > 0, price / high), mean["price_to_high"]),
        "analyst_upside_potential": F.coalesce(upside, mean["analyst_upside_potential"]),
        "concern_level": F.coalesce("concern_level", mean["concern_level"]),
        "sentiment_score": F.coalesce("sentiment_score", mean["sentiment_score"]),
    })


def alpha_score(df: DataFrame) -> DataFrame:
    """Score, label and derived predictions of the fixed model, as column expressions."""
    score = F.lit(0.0)
    for f, (weight, mean, std) in ALPHA_MODEL.items():
        score = score + F.lit(weight) * ((F.col(f) - F.lit(mean)) / F.lit(std))
    s, c = F.col("_alpha"), ALPHA_CUTS

    def label(top, upper, bottom, lower, middle):
        return (F.when(s > c["p90"], top).when(s > c["p75"], upper)
                .when(s < c["p10"], bottom).when(s < c["p25"], lower).otherwise(middle))

    confidence = label("high", "medium", "high", "medium", "low")
    month = F.round(s + ALPHA_MARKET_BASELINE, 2) + F.lit(0.0)
    return df.withColumn("_alpha", score).withColumns({
        "raw_score": F.round(s, 4) + F.lit(0.0),
        "expected_alpha": F.round(s, 2) + F.lit(0.0),
        "signal": label("LONG", "LONG", "SHORT", "SHORT", "NEUTRAL"),
        "confidence": confidence,
        "percentile": label(">90th", "75th-90th", "<10th", "10th-25th", "25th-75th"),
        "predicted_30d_return": month,
        "predicted_7d_return": month * (7 / 30),
        "prediction_confidence": F.when(confidence == "high", 0.85).when(confidence == "medium", 0.65).otherwise(0.5),
    }).drop("_alpha")


def accuracy_report(df: DataFrame) -> DataFrame:
    """One row: directional accuracy and average alpha of LONG and SHORT predictions."""
    a = F.col("actual_alpha")
    long, short = F.col("signal") == "LONG", F.col("signal") == "SHORT"
    right = F.when((long & (a > 0)) | (short & (a < 0)), 1.0).otherwise(0.0)
    judged = (long | short) & a.isNotNull()
    out = df.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count(a).alias("predictions_with_actuals"),
        F.avg(F.when(judged, right)).alias("directional_accuracy"),
        F.avg(F.when(judged & (F.col("confidence") == "high"), right)).alias("high_conf_directional_accuracy"),
        F.avg(F.when(long, a)).alias("avg_long_alpha"),
        F.avg(F.when(short, a)).alias("avg_short_alpha"),
    )
    return out.withColumn("long_short_spread", F.col("avg_long_alpha") - F.col("avg_short_alpha"))


def trade_rules(df: DataFrame) -> DataFrame:
    """Action, position size, target, stop and holding days by signal and confidence."""
    action = F.when(F.col("signal") == "LONG", "BUY").when(F.col("signal") == "SHORT", "SELL").otherwise("HOLD")
    by = lambda high, medium, low: (
        F.when(F.col("signal") == "NEUTRAL", F.lit(low)).when(F.col("confidence") == "high", F.lit(high))
        .when(F.col("confidence") == "medium", F.lit(medium)).otherwise(F.lit(low)))
    return df.withColumns({
        "action": action, "size": by(1.0, 0.5, 0.0), "target_pct": by(8.0, 5.0, None),
        "stop_pct": by(-5.0, -3.0, None), "hold_days": by(30, 30, None),
    })


def trade_rules_legacy(df: DataFrame, confidence: float = 0.60, move: float = 2.0) -> DataFrame:
    sure = F.col("prediction_confidence") >= confidence
    p = F.col("predicted_return")
    return df.withColumn(
        "action", F.when(sure & (p >= move), "BUY").when(sure & (p <= -move), "SELL").otherwise("HOLD"))
