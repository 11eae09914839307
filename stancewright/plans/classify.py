"""Classifying posts with fitted models."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from stancewright import schemas
from stancewright.operators.clean import clean_labelled
from stancewright.operators.embed import embed_text
from stancewright.operators.keys import attach_embeddings
from stancewright.operators.labels import merge_topics, merged_view, unmerge_stance
from stancewright.operators.train import predict_labels, predict_wide


def predict_from_embedding(
    labelled: DataFrame, embeddings: DataFrame, models: Mapping, strict: bool = True
) -> DataFrame:
    """Clean, fold, look up the embeddings and predict every label, in one lazy plan."""
    cleaned = clean_labelled(labelled, on_topic_only=True, in_group_only=True)
    posts = merge_topics(cleaned)
    return predict_labels(attach_embeddings(posts, embeddings, strict=strict), models)


def predict_from_text(
    posts: DataFrame, models: Mapping, embedder="hashing", text: str = "post", key: str = "code",
    **options,
) -> DataFrame:
    """Predict from raw text. Each text is embedded once, whatever the number of labels."""
    return predict_labels(embed_text(posts, embedder, text, key, **options), models, key=key)


def result_view(
    preds: DataFrame,
    unmerge: bool = False,
    three_state: Iterable[str] = tuple(schemas.THREE_STATE_LABELS),
) -> DataFrame:
    return unmerge_stance(preds, three_state) if unmerge else merged_view(preds)


def classify_posts(
    posts: DataFrame,
    embeddings: DataFrame,
    models: Mapping,
    three_state: Iterable[str] = tuple(schemas.THREE_STATE_LABELS),
) -> DataFrame:
    """The table the report reads: posts with one 0/1 column per binary label."""
    return predict_wide(attach_embeddings(posts, embeddings), models, three_state).drop("embedding")
