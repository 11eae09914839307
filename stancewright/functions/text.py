"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_segment(link: Column) -> Column:
    """Part after the last slash: the whole text without one, '' after a final one."""
    return F.substring_index(link, "/", -1)


def sequence_code(position: Column, prefix: str = "TW", width: int = 3) -> Column:
    """``TW000``, ``TW001``, ...; longer numbers keep all their digits."""
    return F.format_string(f"{prefix}%0{width}d", position)


def percent_text(share: Column) -> Column:
    """Share as a percentage with two decimals, ties to the even digit; NULL stays NULL."""
    rounded = F.bround(share * 100, 2)
    return F.when(share.isNotNull(), F.format_string("%.2f%%", rounded))


def _score_part(cell: Column, index: int) -> Column:
    return F.get(F.split(cell, "±"), F.lit(index)).try_cast("double")


def score_mean(cell: Column) -> Column:
    """The number before ± in ``0.92±0.07``; NULL if the text has another form."""
    return _score_part(cell, 0)


def score_spread(cell: Column) -> Column:
    """The number after ± in ``0.92±0.07``; NULL if the text has another form."""
    return _score_part(cell, 1)


def stance_name(side: str, topic: Column) -> Column:
    """``pro war`` from ``pro`` and ``war``."""
    return F.concat_ws(" ", F.lit(side), topic)


def polarity_text(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit("Positive")).otherwise(F.lit("Negative"))
