"""Readers and writers for post, label, embedding and score tables, and models."""

from stancewright.sources.csv_records import read_split_csv
from stancewright.sources.models import (
    load_model,
    load_models,
    model_path,
    save_model,
    save_models,
    save_run,
)
from stancewright.sources.tables import (
    conform,
    export_csv,
    read_classified,
    read_csv_text,
    read_embeddings,
    read_labelled,
    read_posts,
    read_scores,
    save_bucketed,
    write_embeddings,
    write_posts,
)
from stancewright.sources.versions import (
    add_rows,
    compact_store,
    create_store,
    known_codes,
    read_rejects,
    read_store,
)

__all__ = [
    "add_rows", "compact_store", "conform", "create_store", "export_csv", "known_codes", "load_model",
    "load_models", "model_path", "read_classified", "read_csv_text", "read_embeddings", "read_labelled",
    "read_posts", "read_rejects", "read_scores", "read_split_csv", "read_store", "save_bucketed",
    "save_model", "save_models", "save_run", "write_embeddings", "write_posts",
]
