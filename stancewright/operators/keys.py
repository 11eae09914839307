"""Joins by key and checks of keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancewright.functions import sequence_code
from stancewright.operators.ordering import with_position
from stancewright.schemas import col

#: Keys named in an error.
SHOWN = 5


def duplicate_keys(df: DataFrame, key: str = "code") -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, key: str = "code") -> DataFrame:
    """The same table, after checking that the key is unique."""
    found = duplicate_keys(df, key).limit(SHOWN).collect()
    if found:
        raise ValueError(f"{key} is not unique, for example {[row[0] for row in found]}")
    return df


def own_shuffle(df: DataFrame) -> DataFrame:
    """Gives an aggregated join side a shuffle of its own.

    Adaptive execution splits a hot key only where both sides of a join come straight from
    a shuffle. The aggregate is small against the other side, so moving it again is cheap.
    """
    return df.hint("rebalance")


def wanted_rows(df: DataFrame, keys: DataFrame, key: str = "code") -> DataFrame:
    """Rows of a large table whose key occurs in another table.

    An outer or anti join cannot broadcast the side it preserves, so looking up a few
    posts in a huge table would shuffle all of it. A semi join can: where the keys are
    few, Spark broadcasts them and the large table is only scanned.
    """
    return df.join(own_shuffle(keys.select(col(key)).distinct()), key, "left_semi")


def _looked_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key of ``left`` once, with ``_found``, its number of rows in ``right``, or NULL."""
    wanted = left.select(col(key)).distinct()
    present = wanted_rows(right.select(col(key)), wanted, key).groupBy(col(key))
    return wanted.join(present.agg(F.count(F.lit(1)).alias("_found")), key, "left")


def missing_keys(left: DataFrame, right: DataFrame, key: str = "code") -> DataFrame:
    """Keys of ``left`` without a partner in ``right``, once each."""
    return _looked_up(left, right, key).filter(col("_found").isNull()).drop("_found")


def assert_matched(left: DataFrame, right: DataFrame, key: str, what: str) -> None:
    """Fails at once unless every key of ``left`` has exactly one row in ``right``.

    The check reads keys only, and is a job of its own, so nothing that is done with the join
    afterwards can remove it. What comes to the driver is a few keys for the message.
    """
    faults = _looked_up(left, right, key).filter("_found is null or _found > 1")
    found = faults.limit(SHOWN).collect()
    if not found:
        return
    missing = [r[0] for r in found if r["_found"] is None]
    if missing:
        raise LookupError(f"no {what} for {key} {missing}")
    raise LookupError(f"more than one {what} for {key} {[r[0] for r in found]}")


def _strict_join(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """Inner join of which every row of ``left`` is known to have one partner."""
    assert_matched(left, right, key, what)
    return left.join(right, key)


def attach_embeddings(
    posts: DataFrame,
    embeddings: DataFrame,
    key: str = "code",
    strict: bool = False,
    columns: Sequence[str] = ("embedding",),
) -> DataFrame:
    """Posts with their embedding.

    ``strict`` makes a post without one an error, and a post with several; it is checked
    before the plan is made (``assert_matched``). Otherwise posts without one are left out,
    and the store is taken to have one row per key.
    """
    store = embeddings.select(col(key), *[col(n) for n in columns])
    return _strict_join(posts, store, key, "embedding") if strict else posts.join(store, key)


def verify_text(
    posts: DataFrame, store: DataFrame, key: str = "code", text: str = "post", strict: bool = False
) -> DataFrame:
    """Keys whose stored text differs from the text of the post, or that the store lacks.

    The whole texts are compared through their SHA-256, computed before the shuffle: a row
    then moves 32 bytes instead of its text. ``strict`` makes any such key an error.
    """

    def digests(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            col(key),
            F.unhex(F.sha2(col(text), 256)).alias(name),
            F.length(col(text)).alias(f"{name}_chars"),
        )

    stored = wanted_rows(digests(store, "stored").withColumn("in_store", F.lit(True)), posts, key)
    both = digests(posts, "post").join(stored, key, "left").withColumn(
        "in_store", F.coalesce("in_store", F.lit(False))
    )
    differing = both.filter(~col("in_store") | ~col("post").eqNullSafe(col("stored"))).select(
        col(key),
        F.lower(F.hex("post")).alias("post_digest"),
        F.lower(F.hex("stored")).alias("stored_digest"),
        "post_chars",
        "stored_chars",
        "in_store",
    )
    if strict:
        found = differing.limit(SHOWN).collect()
        if found:
            raise LookupError(f"text differs from the store or is absent for {key} {[r[0] for r in found]}")
    return differing


def align_predictions(
    labelled: DataFrame,
    predictions: DataFrame,
    labels: Iterable[str],
    key: str = "code",
    strict: bool = True,
) -> DataFrame:
    """Labelled rows with the prediction of each label as ``pred <label>``."""
    renamed = predictions.select(
        col(key), *[col(n).alias(f"pred {n}") for n in labels]
    )
    if strict:
        return _strict_join(labelled, renamed, key, "prediction")
    return labelled.join(wanted_rows(renamed, labelled, key), key, "left")


def pick_rows(df: DataFrame, keys: DataFrame | Sequence, key: str = "code") -> DataFrame:
    """Rows for a few given keys, or for all keys of another table."""
    if isinstance(keys, DataFrame):
        return wanted_rows(df, keys, key)
    return df.filter(col(key).isin(list(keys)))


def with_sequential_code(
    df: DataFrame, order_by: str, code: str = "code", prefix: str = "TW", width: int = 3
) -> DataFrame:
    """Adds ``TW000``, ``TW001``, ... in the order of a unique column."""
    numbered = with_position(df, order_by, "_position")
    return numbered.withColumn(code, sequence_code(col("_position"), prefix, width)).drop(
        "_position"
    )
