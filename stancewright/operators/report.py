"""Label prevalence, by month as well, and score summaries.

Labels are summed as columns in one aggregate and turned into rows afterwards: no row of
the data is multiplied by the number of labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancewright import schemas
from stancewright.functions import (
    day_first,
    formats_of,
    month_of,
    parse_date,
    percent_text,
    score_mean,
    score_spread,
)
from stancewright.schemas import col

#: Month of posts whose date is missing or cannot be read.
UNREADABLE = "unreadable"


def _date(df: DataFrame, name: str, formats: Iterable[str] | None = None) -> Column:
    """The dates of a column; text by the ``formats`` given, or by the one form that the column tells."""
    if dict(df.dtypes)[name] != "string":
        return col(name)
    return parse_date(col(name), formats_of(day_first(df, name)) if formats is None else formats)


def _sums(labels: Sequence[str]) -> list[Column]:
    """Sums that count a label nobody annotated as 0."""
    return [F.coalesce(F.sum(col(n)), F.lit(0)).cast("long").alias(n) for n in labels]


def _long(df: DataFrame, ids: list[str], labels: Sequence[str]) -> DataFrame:
    return df.unpivot(ids, [col(n) for n in labels], "label", "positives")


def label_counts(df: DataFrame, labels: Iterable[str] = tuple(schemas.REPORT_LABELS)) -> DataFrame:
    """Positives per label."""
    names = list(labels)
    return _long(df.agg(*_sums(names)), [], names)


def _share(positives: Column, total: Column) -> Column:
    """Part of all positives; NULL where there are none."""
    return F.try_divide(positives.cast("double"), total)


def label_prevalence(
    df: DataFrame,
    labels: Iterable[str] = tuple(schemas.REPORT_LABELS),
    date: str | None = None,
    month: int | None = None,
    only: Iterable[str] | None = None,
    formats: Iterable[str] | None = None,
) -> DataFrame:
    """Count and share of each label, most frequent first.

    The share is that of all label assignments, not of posts. ``month`` keeps one month;
    ``only`` picks labels after the share over all labels is computed. Dates that are text are read
    by ``formats``, by default by the one form that the column tells (``day_first``); so are those of
    the other reports.
    """
    if month is not None:
        if date is None:
            raise ValueError("a month needs the date column")
        df = df.filter(F.month(_date(df, date, formats)) == month)
    names = list(labels)
    # The total comes from the same single row as the sums, so no window is needed.
    wide = df.agg(*_sums(names))
    totalled = wide.withColumn("_total", sum((col(n) for n in names), F.lit(0)))
    shares = _long(totalled, ["_total"], names).select(
        "label", "positives", _share(col("positives"), col("_total")).alias("share")
    )
    if only is not None:
        shares = shares.filter(col("label").isin(list(only)))
    # One row per label: sorting them needs no range exchange.
    return (
        shares.withColumn("percentage", percent_text(col("share")))
        .coalesce(1)
        .orderBy(F.desc("positives"), F.asc("label"))
    )


def monthly_counts(
    df: DataFrame,
    labels: Iterable[str] = tuple(schemas.REPORT_LABELS),
    date: str = "date",
    calendar: str = "month",
    formats: Iterable[str] | None = None,
) -> DataFrame:
    """Positives per month and label.

    Posts without a readable date are counted under a NULL month, so that months add up to all
    posts.
    """
    names = list(labels)
    month = month_of(_date(df, date, formats), calendar)
    wide = df.groupBy(month.alias("month")).agg(*_sums(names))
    return _long(wide, ["month"], names)


def monthly_share(
    df: DataFrame,
    labels: Iterable[str] = tuple(schemas.REPORT_LABELS),
    date: str = "date",
    calendar: str = "month",
    formats: Iterable[str] | None = None,
) -> DataFrame:
    """How the positives of each label spread over the months; sums to 1 per label.

    The part of posts without a readable date stands under a NULL month.
    """
    total = F.sum("positives").over(Window.partitionBy("label"))
    return monthly_counts(df, labels, date, calendar, formats).withColumn(
        "share", _share(col("positives"), total)
    )


def months_with_total(
    df: DataFrame, date: str = "date", formats: Iterable[str] | None = None
) -> DataFrame:
    """Rows per month in order, then those without a readable date, and an 'All' row at the end."""
    months = df.select(month_of(_date(df, date, formats)).alias("_month"))
    name = F.coalesce(col("_month").cast("string"), F.lit(UNREADABLE))
    return (
        months.rollup("_month")
        .agg(F.count(F.lit(1)).alias("n_posts"), F.grouping("_month").alias("_total"))
        .coalesce(1)  # fourteen rows at most
        .orderBy("_total", F.asc_nulls_last("_month"))
        .select(F.when(col("_total") == 1, "All").otherwise(name).alias("month"), "n_posts")
    )


def preview(df: DataFrame, order_by: str = "code", n: int = 15) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(col(order_by)).limit(n)


def score_summary(
    scores: DataFrame, metrics: Iterable[str] = ("F1", "ROC AUC"), label: str = "Label"
) -> DataFrame:
    """Published ``mean±spread`` cells as rows (label, split, metric, mean, spread)."""
    cells = [f"{split} {metric}" for metric in metrics for split in ("Train", "Validation")]
    long = scores.unpivot([col(label)], [col(n) for n in cells], "_cell", "_text")
    return long.select(
        col(label).alias("label"),
        F.substring_index("_cell", " ", 1).alias("split"),
        F.expr("substring(_cell, instr(_cell, ' ') + 1)").alias("metric"),
        score_mean(col("_text")).alias("mean"),
        score_spread(col("_text")).alias("spread"),
    )


def stack_scores(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Two score tables in one, tagged with their split."""
    return train.withColumn("split", F.lit("Train")).unionByName(
        validation.withColumn("split", F.lit("Validation"))
    )
