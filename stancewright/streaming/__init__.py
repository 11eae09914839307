"""Posts as they arrive: folding, scoring, and embedding raw ones."""

from stancewright.streaming.score import (
    first_arrivals,
    read_arrivals,
    read_batches,
    read_stream,
    run_to_end,
    score_raw_stream,
    score_stream,
    stance_stream,
)

__all__ = [
    "first_arrivals", "read_arrivals", "read_batches", "read_stream", "run_to_end", "score_raw_stream",
    "score_stream", "stance_stream",
]
