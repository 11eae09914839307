"""Folding pro/anti pairs into one three-state label, and unfolding predictions again.

States: 1 = pro, 0 = anti, 2 = neither, both or unknown.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancewright import schemas
from stancewright.functions import polarity_text, stance_name
from stancewright.schemas import ANTI, NEITHER, PRO, col


def stance(pro: Column, anti: Column) -> Column:
    """State of a pro/anti pair."""
    return (
        F.when((pro == 1) & (anti == 0), PRO)
        .when((pro == 0) & (anti == 1), ANTI)
        .otherwise(NEITHER)
    )


def merge_stance(df: DataFrame, pro: str, anti: str, out: str) -> DataFrame:
    return df.withColumn(out, stance(col(pro), col(anti)))


def merge_topics(
    df: DataFrame, topics: Mapping[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Adds one three-state column per topic."""
    pairs = schemas.TOPIC_PAIRS if topics is None else topics
    return df.withColumns(
        {topic: stance(col(pro), col(anti)) for topic, (pro, anti) in pairs.items()}
    )


def stance_conflicts(
    df: DataFrame, topics: Mapping[str, tuple[str, str]] | None = None, key: str = "code"
) -> DataFrame:
    """Pairs that fold to 2 although they are not a plain (0, 0), with the reason."""
    pairs = schemas.TOPIC_PAIRS if topics is None else topics

    def finding(topic: str, pro: Column, anti: Column) -> Column:
        reason = (
            F.when(pro.isNull() | anti.isNull(), "missing")
            .when((pro == 1) & (anti == 1), "both")
            .when(~pro.isin(0, 1) | ~anti.isin(0, 1), "other")
        )
        return F.struct(
            F.lit(topic).alias("topic"),
            pro.cast("int").alias("pro"),
            anti.cast("int").alias("anti"),
            reason.alias("reason"),
        )

    findings = F.array(*[finding(t, col(p), col(a)) for t, (p, a) in pairs.items()])
    reported = F.filter(findings, lambda f: f["reason"].isNotNull())
    return df.select(col(key), F.inline(reported))


def with_truth(preds: DataFrame) -> DataFrame:
    """Missing ground truth is taken from the prediction."""
    return preds.withColumn("ground_truth", F.coalesce("ground_truth", "prediction"))


def merged_view(preds: DataFrame, key: str = "code") -> DataFrame:
    """One row per post and label: truth, prediction, probability, is_correct."""
    return with_truth(preds).select(
        col(key),
        col("label").alias("key"),
        "ground_truth",
        "prediction",
        "prob",
        (col("ground_truth") == col("prediction")).alias("is_correct"),
    )


def unmerge_stance(
    preds: DataFrame,
    three_state: Iterable[str] = tuple(schemas.THREE_STATE_LABELS),
    key: str = "code",
    full_probs: bool = False,
) -> DataFrame:
    """One row per binary label: a three-state label yields a pro and an anti row.

    The probability of the side not predicted is ``1 - prob``, which also holds the
    neutral mass, and 0 for both sides when the neutral state is predicted. With
    ``full_probs`` it is read from the class probabilities in ``probs`` instead.
    """
    truth, pred, prob = col("ground_truth"), col("prediction"), col("prob")

    def row(name: Column, gt: Column, yes: Column, p: Column) -> Column:
        return F.struct(
            name.alias("key"),
            gt.cast("int").alias("ground_truth"),
            yes.cast("int").alias("prediction"),
            p.cast("double").alias("prob"),
        )

    def side(name: str, state: int) -> Column:
        if full_probs:
            p = F.get(col("probs"), F.lit(state))
        else:
            p = F.when(pred == NEITHER, 0.0).when(pred == state, prob).otherwise(1.0 - prob)
        return row(stance_name(name, col("label")), truth == state, pred == state, p)

    plain = F.array(row(col("label"), truth, pred, prob))
    sides = F.array(side("pro", PRO), side("anti", ANTI))
    rows = F.when(col("label").isin(list(three_state)), sides).otherwise(plain)
    return (
        with_truth(preds)
        .select(col(key), F.inline(rows))
        .withColumn("is_correct", col("ground_truth") == col("prediction"))
        .withColumn("polarity", polarity_text(col("prediction")))
    )
