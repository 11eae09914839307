"""Cleaning of annotated posts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancewright import schemas
from stancewright.functions import last_segment, nan_to_null
from stancewright.operators.keys import own_shuffle, wanted_rows
from stancewright.schemas import col


def null_out_nan(df: DataFrame) -> DataFrame:
    """NaN in any float column becomes NULL."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ]
    return df.withColumns({name: nan_to_null(col(name)) for name in floats}) if floats else df


def canonical_labels(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Label columns under one spelling, whatever the source calls them."""
    return df.withColumnsRenamed(dict(schemas.SHEET_ALIASES if aliases is None else aliases))


def extract_code(df: DataFrame, link: str = "permalink", code: str = "code") -> DataFrame:
    """Adds the key: the last path segment of the permalink."""
    return df.withColumn(code, last_segment(col(link)))


def training_view(
    df: DataFrame, labels: Iterable[str] | None = None, text: str = "post", key: str = "code"
) -> DataFrame:
    """Key, text and labels; without a label list, every column but the text is a label."""
    names = [n for n in df.columns if n not in (text, key)] if not labels else list(labels)
    return df.select(col(key), col(text), *[col(n) for n in names])


def _single_fix(name: str) -> Column:
    """The correction of one column as a struct, which is NULL where there is none."""
    # A struct compares its NULL fields, so corrections to NULL and to a value contradict too.
    fix = F.when(col("column") == name, F.struct(col("value").alias("value")))
    message = F.concat(F.lit(f"contradictory corrections of {name}: "), F.to_json(F.min(fix)), F.to_json(F.max(fix)))
    return F.when(F.min(fix) == F.max(fix), F.max(fix)).when(
        F.min(fix).isNotNull(), F.raise_error(message).cast("struct<value:int>")
    )


def apply_corrections(
    df: DataFrame, corrections: DataFrame, columns: Iterable[str], key: str = "code"
) -> DataFrame:
    """Cells replaced by the corrections ``(code, column, value)``.

    Corrections are first folded to one row per code with one field per column, so the
    join stays one to one. Spark broadcasts that side when its measured size allows. A
    correction to NULL empties the cell. Corrections of one cell that contradict each other
    fail the running job; ``duplicate_corrections`` lists the cells.
    """
    names = list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    folded = (
        corrections.filter(col("column").isin(names))
        .groupBy(col("code").alias("_patched"))
        .agg(*[_single_fix(name).alias(f"_fix{i}") for i, name in enumerate(names)])
    )
    fixed = {
        name: F.when(col(f"_fix{i}").isNull(), col(name)).otherwise(
            col(f"_fix{i}")["value"].cast(types[name])
        )
        for i, name in enumerate(names)
    }
    return (
        df.join(own_shuffle(folded), df[key] == folded["_patched"], "left")
        .withColumns(fixed)
        .select(*[col(n) for n in df.columns])
    )


def duplicate_corrections(corrections: DataFrame) -> DataFrame:
    """Cells with more than one correction."""
    return corrections.groupBy("code", "column").count().filter("count > 1")


def unmatched_corrections(df: DataFrame, corrections: DataFrame, key: str = "code") -> DataFrame:
    """Corrections for a column or a post the table does not have."""
    known = wanted_rows(df.select(col(key).alias("code")), corrections, "code").distinct()
    bad_column = corrections.filter(~col("column").isin(df.columns))
    bad_code = corrections.filter(col("column").isin(df.columns)).join(known, "code", "left_anti")
    return bad_column.unionByName(bad_code)


def drop_incomplete(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows without a missing value in the given columns, or in any column."""
    return df.na.drop("any", subset=list(columns) if columns is not None else None)


def fill_missing(df: DataFrame, text_columns: Iterable[str] = ()) -> DataFrame:
    """'unknown' in the given text columns and 0 in every numeric column."""
    present = [name for name in text_columns if name in df.columns]
    return (df.na.fill("unknown", subset=present) if present else df).na.fill(0)


def keep_zero(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is 0; a missing flag does not pass."""
    return df.filter(col(flag) == 0)


def clean_labelled(
    df: DataFrame,
    drop_missing: bool = True,
    on_topic_only: bool = False,
    in_group_only: bool = False,
    corrections: DataFrame | None = None,
    required: Iterable[str] = tuple(schemas.REQUIRED_LABELS),
    correctable: Iterable[str] = tuple(schemas.BINARY_LABELS),
    author_columns: Iterable[str] = tuple(schemas.AUTHOR_COLUMNS),
    off_topic: str = schemas.OFF_TOPIC,
    out_group: str = schemas.OUT_GROUP,
    link: str | None = "permalink",
) -> DataFrame:
    """The whole cleaning job: key, corrections, missing values, row filters.

    Rows lacking a required label go, then every other missing label counts as 0. With
    ``drop_missing`` off nothing is filled, and the filters still drop rows whose flag is
    missing. ``link=None`` is for a table that already has its ``code``.
    """
    df = null_out_nan(df)
    if link is not None:
        df = extract_code(df, link)
    if corrections is not None:
        patchable = [name for name in correctable if name in df.columns]
        df = apply_corrections(df, corrections, patchable)
    if drop_missing:
        df = fill_missing(drop_incomplete(df, required), author_columns)
    if on_topic_only:
        df = keep_zero(df, off_topic)
    if in_group_only:
        df = keep_zero(df, out_group)
    return df


def cleaning_audit(before: DataFrame, after: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Row count and positives per label, before and after cleaning."""
    names = list(labels)

    def totals(df: DataFrame, stage: str) -> DataFrame:
        sums = [F.coalesce(F.sum(col(n)), F.lit(0)).cast("long").alias(n) for n in names]
        wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *sums)
        return wide.withColumn("stage", F.lit(stage)).unpivot(
            ["stage", "n_rows"], [col(n) for n in names], "label", "positives"
        )

    return totals(before, "before").unionByName(totals(after, "after"))
