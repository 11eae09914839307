"""Tables in and out.

Columns are matched by name and cast to the declared schema, so neither the column
order of a file nor an inference pass over its data matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancewright import schemas
from stancewright.schemas import col
from stancewright.sources.csv_records import read_split_csv


def read_csv_text(spark: SparkSession, path: str, multi_line: bool | str = True) -> DataFrame:
    """CSV with a header, every column as text.

    Posts hold line breaks, hence ``multi_line``; Spark then reads each file in one
    task. ``multi_line='split'`` gives the same rows from many tasks a file
    (``read_split_csv``). Where no cell holds a line break, pass ``multi_line=False`` and the
    files are split as usual. An empty cell is NULL, quoted or not.
    """
    if multi_line == "split":
        return read_split_csv(spark, path)
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def _whole_number(value: Column, name: str) -> Column:
    """Text or float cell as an integer; NaN and unreadable text become NULL."""
    number = value.try_cast("double")
    whole = F.when(number == F.floor(number), number.try_cast("int"))
    message = F.concat(F.lit(f"column {name} holds no whole number: "), value.cast("string"))
    broken = number.isNotNull() & ~F.isnan(number) & whole.isNull()
    return F.when(broken, F.raise_error(message).cast("int")).otherwise(whole)


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Declared columns by name, cast to their declared types.

    A column the table lacks becomes NULL; NaN in a label becomes NULL here, because
    Spark, unlike pandas, lets NaN win a sum.
    """
    present = dict(df.dtypes)
    columns = []
    for field in schema.fields:
        if field.name not in present:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.IntegerType) and present[field.name] != "int":
            value = _whole_number(col(field.name), field.name)
        else:
            value = col(field.name).cast(field.dataType)
        columns.append(value.alias(field.name))
    if keep_extra:
        declared = set(schema.fieldNames())
        columns += [col(name) for name in df.columns if name not in declared]
    return df.select(*columns)


def _read(spark: SparkSession, path: str, fmt: str, multi_line: bool | str = True) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        return read_csv_text(spark, path, multi_line)
    raise ValueError(f"format must be 'csv' or 'parquet', not {fmt!r}")


def read_labelled(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool | str = True
) -> DataFrame:
    """Human-labelled posts, label columns under their canonical names."""
    raw = _read(spark, path, fmt, multi_line).withColumnsRenamed(schemas.SHEET_ALIASES)
    return conform(raw, schemas.LABELLED, keep_extra=True)


def read_posts(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool | str = "split"
) -> DataFrame:
    """The unlabelled corpus; columns beyond the declared ones are kept.

    CSV is read by many tasks a file, see ``read_csv_text``.
    """
    return conform(_read(spark, path, fmt, multi_line), schemas.POSTS, keep_extra=True)


def read_classified(
    spark: SparkSession, all_path: str, relevant_path: str | None = None,
    relevant_only: bool = False,
) -> DataFrame:
    """Classified posts: the whole corpus, or the part kept as relevant.

    Declared columns that are there are cast to their types, NaN labels become NULL.
    """
    if relevant_only and relevant_path is None:
        raise ValueError("relevant_only needs the path of the relevant posts")
    found = spark.read.parquet(relevant_path if relevant_only else all_path)
    declared = [f for f in schemas.CLASSIFIED.fields if f.name in found.columns]
    return conform(found, T.StructType(declared), keep_extra=True)


def read_embeddings(
    spark: SparkSession, path: str, key: str = "code", vector: str = "embedding"
) -> DataFrame:
    """Embedding store as ``code`` and ``embedding``, whatever its columns are called."""
    return spark.read.parquet(path).select(
        col(key).alias("code"), col(vector).cast("array<float>").alias("embedding")
    )


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score summary with ``mean±spread`` cells."""
    return conform(read_csv_text(spark, path), schemas.SCORES)


def write_posts(df: DataFrame, path: str, mode: str = "error", by: str | None = None) -> None:
    """Posts as Parquet, optionally in one folder per value of ``by`` (a month, say)."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_embeddings(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def save_bucketed(
    df: DataFrame, table: str, key: str = "code", buckets: int = 200, path: str | None = None,
    mode: str = "error",
) -> None:
    """Table bucketed and sorted by its key, below ``path`` or in the warehouse.

    Two tables saved with the same bucket count join on the key without a shuffle.
    """
    writer = df.write.mode(mode).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def export_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header, UTF-8, one file per task; arrays are written as JSON text."""
    flat = [
        F.to_json(col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else col(f.name)
        for f in df.schema.fields
    ]
    (
        df.select(*flat)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
