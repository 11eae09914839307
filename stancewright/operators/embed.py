"""Text embeddings and their projection.

An embedder is one of

- a factory: called once per task, it loads its model and returns a function from a list
  of texts to one vector per text. Local models and remote services both fit;
- a fitted ``PipelineModel``, such as ``fit_tfidf`` returns;
- ``'hashing'``, which needs neither a model nor fitting.

A text gets the same vector whatever other texts are embedded with it, so a store can be
extended later and new posts compared with old ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancewright.functions import to_vector
from stancewright.operators.keys import missing_keys
from stancewright.schemas import col

Factory = Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]
Embedder = str | Factory | PipelineModel

#: Characters kept of the reason why a text was rejected.
REASON_CHARS = 500


def _text_column(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_text", F.coalesce(col(text), F.lit("")))


def _hashed_terms(dim: int) -> list:
    """Words in any alphabet, counted by hash."""
    words = RegexTokenizer(
        inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True
    )
    return [words, HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim)]


def _hashing(dim: int) -> PipelineModel:
    """Hashed term counts of unit length."""
    unit = Normalizer(inputCol="_counts", outputCol="_vector", p=2.0)
    return PipelineModel([*_hashed_terms(dim), unit])


def fit_tfidf(
    df: DataFrame, text: str = "post", dim: int = 256, partitions: int | None = None
) -> PipelineModel:
    """An embedder that weighs hashed terms by their rarity in this corpus.

    Fit it once, save it, and use it for training, for later posts and on streams.
    ``partitions`` deals the texts anew, see ``embed_text``.
    """
    rarity = IDF(inputCol="_counts", outputCol="_vector")
    texts = _text_column(_dealt(df.select(col(text)), partitions), text)
    return Pipeline(stages=[*_hashed_terms(dim), rarity]).fit(texts)


def _dealt(df: DataFrame, partitions: int | None) -> DataFrame:
    return df if partitions is None else df.repartition(partitions)


def _called(df: DataFrame, embedder: Factory, key: str, batch_size: int) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
        ]
    )

    def embed_batches(batches):
        encode = embedder()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                vectors = encode(part.column(1).to_pylist())
                if len(vectors) != part.num_rows:
                    raise ValueError("an embedder must return one vector per text")
                yield pa.RecordBatch.from_arrays([part.column(0), _vector_column(vectors)], [key, "embedding"])

    texts = _text_column(df, "_source").select(col(key), "_text")
    return texts.mapInArrow(embed_batches, schema)


def _patient(encode, attempts: int, pause: float):
    """``encode`` called again after a failure, each time after twice the pause."""

    def call(texts: list[str]):
        for turn in range(attempts):
            try:
                vectors = encode(texts)
                if len(vectors) != len(texts):
                    raise ValueError("an embedder must return one vector per text")
                return [np.asarray(v, np.float32) for v in vectors]
            except Exception:
                if turn + 1 == attempts:
                    raise
                time.sleep(pause * 2**turn)

    return call


def _or_reason(call, texts: list[str]) -> list[tuple]:
    """(vector, None) or (None, reason) of each text; a failing batch is halved to find the texts at fault."""
    try:
        return [(v, None) for v in call(texts)]
    except Exception as fault:
        if len(texts) == 1:
            return [(None, f"{type(fault).__name__}: {fault}"[:REASON_CHARS])]
    half = len(texts) // 2
    return _or_reason(call, texts[:half]) + _or_reason(call, texts[half:])


def embed_or_reject(
    df: DataFrame, embedder: Embedder, text: str = "post", key: str = "code", batch_size: int = 1000,
    attempts: int = 5, pause: float = 1.0, dim: int = 256,
) -> DataFrame:
    """``(key, embedding, error)`` for each row: a vector, or the reason why there is none.

    A call of a factory's function that fails is made ``attempts`` times, with a pause between that starts at
    ``pause`` seconds and doubles. If it still fails, its texts are tried in halves, so that only texts
    that fail by themselves are rejected. Other embedders do not fail.
    """
    none = F.lit(None).cast("string").alias("error")
    if not callable(embedder):
        return embed_text(df, embedder, text, key, dim=dim).select(col(key), "embedding", none)
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType), T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
            T.StructField("error", T.StringType()),
        ]
    )

    def embed_batches(batches):
        call = _patient(embedder(), attempts, pause)
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                vectors, reasons = zip(*_or_reason(call, part.column(1).to_pylist()))
                missing = pa.array([v is None for v in vectors])
                found = _vector_column([() if v is None else v for v in vectors])
                found = pc.if_else(missing, pa.scalar(None, found.type), found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), found, pa.array(reasons, pa.string())], [key, "embedding", "error"]
                )

    texts = _text_column(df.select(col(key), col(text).alias("_source")), "_source").select(col(key), "_text")
    return texts.mapInArrow(embed_batches, schema)


def _vector_column(vectors) -> pa.Array:
    """A list column from one block of numbers, or vector by vector if lengths differ."""
    vectors = [np.asarray(v, np.float32) for v in vectors]
    offsets = np.cumsum([0, *map(len, vectors)]).astype(np.int32)
    values = np.concatenate(vectors) if vectors else np.empty(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def embed_text(
    df: DataFrame,
    embedder: Embedder = "hashing",
    text: str = "post",
    key: str = "code",
    dim: int = 256,
    batch_size: int = 1000,
    partitions: int | None = None,
) -> DataFrame:
    """``(key, embedding)`` for each row.

    ``dim`` is the vector length of ``'hashing'``; a factory is handed at most
    ``batch_size`` texts at a time. A missing text counts as an empty one. By default the
    texts are embedded where they are read; ``partitions`` deals them out to so many tasks
    first, which pays for a slow embedder over few file splits.
    """
    if embedder == "hashing":
        embedder = _hashing(dim)
    if not callable(embedder) and not isinstance(embedder, PipelineModel):
        raise ValueError(f"embedder must be 'hashing', a factory or a model, not {embedder!r}")
    texts = _dealt(df.select(col(key), col(text).alias("_source")), partitions)
    if isinstance(embedder, PipelineModel):
        vectors = embedder.transform(_text_column(texts, "_source"))
        return vectors.select(col(key), vector_to_array("_vector", "float32").alias("embedding"))
    return _called(texts, embedder, key, batch_size)


def embed_missing(
    posts: DataFrame,
    store: DataFrame,
    embedder: Embedder,
    text: str = "post",
    key: str = "code",
    **options,
) -> DataFrame:
    """Embeddings of the posts the store lacks, one per key; append these to the store."""
    # Keys alone tell what is new; then only the texts of new posts move, if few by broadcast.
    wanted = missing_keys(posts, store, key)
    new = one_text_per_key(posts.join(wanted, key, "left_semi"), text, key)
    return embed_text(new, embedder, text, key, **options)


def one_text_per_key(posts: DataFrame, text: str = "post", key: str = "code") -> DataFrame:
    """``(key, text)`` once per key; of several texts the first by digest, in every run."""
    return posts.groupBy(col(key)).agg(F.min_by(col(text), F.xxhash64(col(text))).alias(text))


def vector_lengths(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Shortest and longest vector; they must agree before training."""
    n = F.size(col(vector))
    return df.agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.count(n).alias("n_rows"))


def embedding_dim(df: DataFrame, vector: str = "embedding") -> int:
    """The common vector length."""
    shortest, longest, _ = vector_lengths(df, vector).first()
    if shortest is None or shortest != longest:
        raise ValueError(f"embedding lengths differ: {shortest} to {longest}")
    return shortest


def pca(
    df: DataFrame, n: int = 2, vector: str = "embedding", out: str = "components"
) -> DataFrame:
    """Centred projection on the first n principal components; signs are free."""
    centred = StandardScaler(inputCol="_x", outputCol="_centred", withMean=True, withStd=False)
    data = df.withColumn("_x", to_vector(col(vector)))
    data = centred.fit(data).transform(data)
    projected = PCA(k=n, inputCol="_centred", outputCol="_pc").fit(data).transform(data)
    return projected.withColumn(out, vector_to_array("_pc")).drop("_x", "_centred", "_pc")
