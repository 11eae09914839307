"""Splits, folds and weights.

Splits follow from a hash of the key, never from row order or a random generator: the
same post lands in the same split in every run and after any repartitioning.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancewright.functions import to_vector
from stancewright.operators.ordering import seeded_hash, with_hash_rank
from stancewright.schemas import col

DEFAULT_SPLIT = {"train": 0.7, "val": 0.21, "test": 0.09}


def split_by_key(
    df: DataFrame,
    key: str = "code",
    weights: Mapping[str, float] | None = None,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Assigns each row to a split by its key hash; sizes hold on average. No shuffle."""
    shares = dict(DEFAULT_SPLIT if weights is None else weights)
    if abs(sum(shares.values()) - 1) > 1e-9 or min(shares.values()) < 0:
        raise ValueError("weights must be non-negative and sum to 1")
    names = list(shares)
    digest = seeded_hash(key, seed)
    value = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        edge = min(int(sum(shares[n] for n in names[: i + 1]) * 2**32), 2**32 - 1)
        value = F.when(digest < f"{edge:08x}", F.lit(names[i])).otherwise(value)
    return df.withColumn(out, value)


def split_exact(
    df: DataFrame,
    key: str = "code",
    held_out: float = 0.3,
    test: float = 0.3,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """The same with exact sizes: ``ceil`` of the held-out part, then of its test part."""
    ranked = with_hash_rank(df, key, seed, name="_rank")
    n_held = F.ceil(F.lit(held_out) * col("_rank_total"))
    n_test = F.ceil(F.lit(test) * n_held)
    split = (
        F.when(col("_rank") < n_test, "test").when(col("_rank") < n_held, "val").otherwise("train")
    )
    return ranked.withColumn(out, split).drop("_rank", "_rank_total")


def stratified_folds(
    df: DataFrame, label: str, k: int, key: str = "code", seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Folds 0 to k-1 of equal size within each class."""
    ranked = with_hash_rank(df, key, seed, [label], "_rank")
    return ranked.withColumn(out, (col("_rank") % k).cast("int")).drop("_rank", "_rank_total")


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(col(split)).agg(F.count(F.lit(1)).alias("n_rows"))


def class_counts(df: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Rows per label and class.

    Rows are first counted per combination of labels, of which there are few; only the
    combinations are multiplied by the number of labels.
    """
    names = list(labels)
    combinations = df.groupBy(*[col(n).cast("int").alias(n) for n in names]).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        combinations.unpivot(["_n"], [col(n) for n in names], "label", "class")
        .filter(col("class").isNotNull())
        .groupBy("label", "class")
        .agg(F.sum("_n").alias("n_rows"))
    )


def n_classes(df: DataFrame, labels: Iterable[str]) -> DataFrame:
    return class_counts(df, labels).groupBy("label").agg(F.count(F.lit(1)).alias("n_classes"))


def class_weights(df: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Balanced weights: rows / (classes present * rows of the class)."""
    per_label = Window.partitionBy("label")
    total, present = F.sum("n_rows").over(per_label), F.count(F.lit(1)).over(per_label)
    return class_counts(df, labels).select(
        "label", "class", "n_rows", (total / (present * col("n_rows"))).alias("weight")
    )


def pos_weights(df: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Rows not positive per positive row, for each binary label."""
    names = list(labels)
    sums = [F.coalesce(F.sum(col(n)), F.lit(0)).cast("double").alias(n) for n in names]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *sums)
    return wide.unpivot(["_n"], [col(n) for n in names], "label", "_pos").select(
        "label", ((col("_n") - col("_pos")) / (col("_pos") + 1e-5)).alias("weight")
    )


def training_frame(
    df: DataFrame, label: str, features: str = "embedding", key: str = "code",
    weights: Sequence | None = None,
) -> DataFrame:
    """``(key, features, label, weight)`` as the estimators take it.

    ``weights`` holds the (class, weight) pairs of one label; there are as many as classes.
    """
    weight = F.lit(1.0)
    if weights:
        lookup = F.create_map(*[F.lit(v) for c, w in weights for v in (int(c), float(w))])
        weight = F.try_element_at(lookup, col(label).cast("int"))
    return df.filter(col(label).isNotNull()).select(
        col(key),
        to_vector(col(features)).alias("features"),
        col(label).cast("double").alias("label"),
        weight.alias("weight"),
    )
