"""Scoring and folding posts as they arrive.

Folding, and scoring posts that have their vectors, works on one row at a time: it needs neither
state nor watermarks, and a replayed batch gives the same rows. Raw posts are embedded first, once
each: codes that arrive again are dropped by state bounded by a watermark, and what a batch gives
replaces what an interrupted run of the same batch has left.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancewright.operators.clean import null_out_nan
from stancewright.operators.embed import Embedder, embed_text
from stancewright.operators.labels import merge_topics, unmerge_stance
from stancewright.operators.train import predict_labels


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options
) -> DataFrame:
    """Files of a folder as they arrive; ``maxFilesPerTrigger`` bounds a batch."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def score_stream(
    stream: DataFrame, models: Mapping, features: str = "embedding", key: str = "code",
    three_state=None,
) -> DataFrame:
    """Predictions for a stream of posts with embeddings; unfolded if states are named."""
    preds = predict_labels(stream, models, features, key)
    return preds if three_state is None else unmerge_stance(preds, three_state, key)


def read_arrivals(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", arrived: str = "arrived",
    **options,
) -> DataFrame:
    """``read_stream`` with the time at which each row's file was written, for want of a time of its own."""
    stream = read_stream(spark, path, schema, fmt, **options)
    return stream.select("*", F.col("_metadata.file_modification_time").alias(arrived))


def first_arrivals(
    stream: DataFrame, key: str = "code", arrived: str = "arrived", delay: str = "1 day"
) -> DataFrame:
    """Each key once: rows that repeat a key within ``delay`` of its first row are dropped.

    The state holds the keys of that time only. Rows without a key are one key.
    """
    return stream.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([key])


def score_raw_stream(
    stream: DataFrame, models: Mapping, embedder: Embedder, predictions: str, store: str, checkpoint: str,
    text: str = "post", key: str = "code", three_state=None, **options,
) -> None:
    """Embeds and scores what has arrived of a stream of raw posts, then stops; the next run goes on.

    Vectors go to ``store`` and predictions to ``predictions``, Parquet in one folder per batch
    (``read_batches``). A batch replaces its own folders, so one that was interrupted, or is run again
    after the driver was lost, leaves no row twice. Each text is embedded once: predictions are made
    from the vectors as stored. ``options`` are those of ``embed_text``. A new checkpoint counts batches
    from 0 again and needs new folders.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        vectors = embed_text(batch, embedder, text, key, **options)
        vectors.write.mode("overwrite").parquet(f"{store}/batch={number}")
        stored = spark.read.schema(vectors.schema).parquet(f"{store}/batch={number}")
        scored = score_stream(stored, models, key=key, three_state=three_state)
        scored.write.mode("overwrite").parquet(f"{predictions}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches that ``score_raw_stream`` has finished."""
    return spark.read.parquet(path).drop("batch")


def stance_stream(stream: DataFrame, topics: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Folded labels for a stream of annotated posts."""
    return merge_topics(null_out_nan(stream), topics)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what has arrived to Parquet and stops; the next run goes on from there."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
