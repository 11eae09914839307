"""Keeping the embedding store complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancewright.operators.embed import Embedder, embed_missing, embed_or_reject, embed_text, one_text_per_key
from stancewright.operators.keys import own_shuffle
from stancewright.schemas import col
from stancewright.session import drop_scratch, scratch_path
from stancewright.sources import read_embeddings, write_embeddings
from stancewright.sources.versions import add_rows, known_codes, read_store


def build_store(posts: DataFrame, path: str, embedder="hashing", **options) -> None:
    """Embeds every post, once per code."""
    write_embeddings(embed_text(one_text_per_key(posts), embedder, **options), path)


def extend_store(
    spark: SparkSession, posts: DataFrame, path: str, embedder="hashing", **options
) -> None:
    """Embeds only the posts the store lacks and appends them."""
    new = embed_missing(posts, read_embeddings(spark, path), embedder, **options)
    write_embeddings(new, path, mode="append")


def text_code(text: Column) -> Column:
    """The code of a text by its content: equal texts have one. NULL is an empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def embed_texts(
    posts: DataFrame, path: str, embedder: Embedder, text: str = "post", wave_texts: int = 1_000_000,
    max_rejects: int = 1_000, retry_rejects: bool = False, **options,
) -> int:
    """Brings the vectors of all texts of ``posts`` into a versioned store, by content; tells how many were new.

    A text is embedded once, whatever the number of posts that hold it, and never again. The work goes in
    waves of about ``wave_texts`` texts, each kept as soon as it is done: what fails later, or a driver that
    dies, costs the wave at work, and the next call goes on with the rest. Texts that cannot be embedded
    are kept with their reason (``read_rejects``); a wave with over ``max_rejects`` of them fails and is not
    kept, as then the service is at fault and not the texts. ``retry_rejects`` tries earlier ones again.
    ``options`` are those of ``embed_or_reject``.
    """
    spark = posts.sparkSession
    coded = posts.select(text_code(col(text)).alias("code"), col(text).alias("text"))
    # Codes alone tell what is new, before any text moves.
    known = known_codes(spark, path, with_rejects=not retry_rejects)
    wanted = coded.select("code").distinct().join(known, "code", "left_anti")
    todo = scratch_path(spark, "texts")
    waves = max(1, -(-wanted.count() // wave_texts))
    new = coded.join(own_shuffle(wanted), "code", "left_semi").groupBy("code").agg(F.any_value("text").alias("text"))
    new.withColumn("wave", F.pmod(F.xxhash64("code"), F.lit(waves))).write.partitionBy("wave").parquet(todo)
    pending = spark.read.schema("code string, text string, wave long").parquet(todo)
    embedded = 0
    for wave in range(waves):
        rows = embed_or_reject(pending.filter(F.col("wave") == wave), embedder, "text", "code", **options)
        done = scratch_path(spark, "wave")
        rows.write.parquet(done)
        rows = spark.read.schema(rows.schema).parquet(done)
        total, rejects = rows.agg(F.count(F.lit(1)), F.count("error")).first()
        if rejects > max_rejects:
            reasons = [r[0] for r in rows.select("error").filter("error is not null").limit(3).collect()]
            raise RuntimeError(f"{rejects} of {total} texts could not be embedded, for example {reasons}")
        add_rows(spark, path, rows)
        drop_scratch(spark, done)
        embedded += total - rejects
    drop_scratch(spark, todo)
    return embedded


def attach_by_text(posts: DataFrame, path: str, text: str = "post") -> DataFrame:
    """Posts with the embedding of their text; posts whose text the store lacks are left out."""
    store = read_store(posts.sparkSession, path).withColumnRenamed("code", "_text_code")
    return posts.withColumn("_text_code", text_code(col(text))).join(store, "_text_code").drop("_text_code")
