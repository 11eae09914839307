"""Exact positions without a single-task window.

A window without a partition column sorts a whole table in one task. Both functions here
split the work into slices by value, count per slice, and add up the few counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancewright.schemas import col
from stancewright.session import materialise

def with_position(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Zero-based position of each row in the order of a unique key.

    Only the key is sorted, and moved once: a slice of the range partitioning holds all copies of its
    keys, and the place in it is that of the sorted row. The numbered keys are checkpointed, because
    their slices are read twice (to add up the slice sizes, and to number) and both readings must see
    the same slice bounds even if an executor is lost in between. A repeated key is an error. So is a
    NULL key, which has no place.
    """
    message = F.concat(F.lit(f"{key} is not unique: "), col(key).cast("string"))
    fault = (
        F.when(col(key).isNull(), F.raise_error(F.lit(f"{key} is NULL")).cast("boolean"))
        .when(col("_copies") > 1, F.raise_error(message).cast("boolean"))
        .otherwise(True)
    )
    # Slice in the upper bits, number of the row in its slice in the lower 33.
    place = F.monotonically_increasing_id()
    placed = materialise(
        df.select(col(key))
        .repartitionByRange(col(key))
        .groupBy(col(key))
        .agg(F.count(F.lit(1)).alias("_copies"))
        .filter(fault)
        .sortWithinPartitions(col(key))
        .select(col(key), place.alias("_place"))
        .select(col(key), F.shiftright("_place", 33).alias("_slice"), F.expr("_place & 8589934591").alias("_at"))
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        placed.groupBy("_slice")
        .count()
        .select("_slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_start"))
    )
    # One row per slice: its size is the number of shuffle partitions, not of data.
    numbered = placed.join(F.broadcast(starts), "_slice").select(
        col(key), (col("_start") + col("_at")).alias(name)
    )
    return df.join(numbered, key)


def with_hash_rank(
    df: DataFrame,
    key: str,
    seed: int | str,
    strata: Sequence[str] = (),
    name: str = "hash_rank",
    digits: int = 4,
) -> DataFrame:
    """Zero-based rank of each row by the hash of its key, within its stratum.

    Rows are cut into ``16 ** digits`` slices by the leading hash digits. A stratum with a
    third of all rows is thus spread over all slices; the rank is the number of rows in
    lower slices plus the place inside the slice. The slice follows from the key alone, so
    both readings of the input agree. Adds ``<name>_total``, the size of the stratum. A key that a
    stratum has twice is an error: its rows would be ranked at random, and parted by a split.
    """
    # A struct compares its NULL fields as equal, so rows of a NULL stratum are ranked too.
    stratum = F.struct(*[col(n) for n in strata]) if strata else F.lit(0)
    hashed = df.withColumn("_hash", seeded_hash(key, seed)).withColumns(
        {"_stratum": stratum, "_slice": F.substring("_hash", 1, digits)}
    )
    whole = Window.partitionBy("_stratum")
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("_stratum", "_slice")
        .count()
        .select(
            "_stratum",
            "_slice",
            F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_start"),
            F.sum("count").over(whole).alias(f"{name}_total"),
        )
    )
    inside = Window.partitionBy("_stratum", "_slice").orderBy("_hash", col(key))
    message = F.concat(F.lit(f"{key} is not unique: "), F.coalesce(col(key).cast("string"), F.lit("NULL")))
    repeated = (col("_at") > 0) & col("_before").eqNullSafe(col(key))
    ranked = (
        hashed.withColumns({"_at": F.row_number().over(inside) - 1, "_before": F.lag(col(key)).over(inside)})
        .filter(F.when(repeated, F.raise_error(message).cast("boolean")).otherwise(True))
    )
    return ranked.join(starts, ["_stratum", "_slice"]).select(
        *[col(n) for n in df.columns],
        (col("_start") + col("_at")).alias(name),
        col(f"{name}_total"),
    )


def seeded_hash(key: str, seed: int | str):
    """MD5 of ``seed:key`` in hex: the same in every run and under any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), col(key).cast("string")))
