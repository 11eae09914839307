"""Numeric and array expressions for scores and embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row.

    A column named inside a lambda is computed anew for every element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logits: Column) -> Column:
    """Class probabilities, shifted by the largest logit so that exp cannot overflow."""

    def shifted(z: Column) -> Column:
        return _bound(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))

    def normed(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
        return _bound(total, lambda t: F.transform(powers, lambda p: p / t))

    return _bound(logits, lambda z: _bound(shifted(z), normed))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def argmax(values: Column) -> Column:
    """Zero-based index of the largest value, the lowest index on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_probability(probs: Column) -> Column:
    return F.array_max(probs).cast("double")


def threshold(score: Column, cut: float = 0.5) -> Column:
    """1 strictly above the cut, else 0; NaN is not above it, NULL stays NULL."""
    above = (score > cut) & ~F.isnan(score)
    return F.when(score.isNotNull(), F.when(above, 1).otherwise(0))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def to_vector(values: Column) -> Column:
    """Array column as an ML vector; used only where an estimator needs one."""
    return array_to_vector(values)
