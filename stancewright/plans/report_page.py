"""The report over classified posts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from stancewright import schemas
from stancewright.operators.keys import align_predictions
from stancewright.operators.metrics import binary_scores, confusion_wide
from stancewright.operators.report import (
    label_prevalence,
    monthly_share,
    months_with_total,
    score_summary,
)
from stancewright.schemas import col


def evaluate_against_labels(
    classified: DataFrame,
    labelled: DataFrame,
    labels: Iterable[str] = tuple(schemas.BINARY_LABELS),
    key: str = "code",
) -> DataFrame:
    """Scores of each binary label of the classified posts against human labels.

    A human-labelled post missing from the classified ones is an error.
    """
    names = list(labels)
    truth = labelled.select(col(key), *[col(n) for n in names])
    aligned = align_predictions(truth, classified, names, key)
    counts = confusion_wide(aligned, {n: (n, f"pred {n}") for n in names})
    return binary_scores(counts)


def report_page(
    classified: DataFrame,
    labelled: DataFrame | None = None,
    scores: DataFrame | None = None,
    date: str = "date",
    month: int | None = None,
    only: Iterable[str] | None = None,
) -> dict[str, DataFrame]:
    """Every table of the report, each lazy: only those used are computed.

    With ``month`` the month panel shows that month's prevalence, else the spread of each
    label over the months.
    """
    tables = {
        "prevalence": label_prevalence(classified),
        "months": months_with_total(classified, date),
        "by_month": monthly_share(classified, date=date)
        if month is None
        else label_prevalence(classified, date=date, month=month, only=only),
    }
    if labelled is not None:
        tables["evaluation"] = evaluate_against_labels(classified, labelled)
    if scores is not None:
        tables["scores"] = score_summary(scores)
    return tables
