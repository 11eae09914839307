"""Removal of word windows that occur more than once in the corpus.

The Rabin-Karp hash of every window is counted across the whole table (``repeats``); the
windows that recur are merged into maximal intervals, whose words go. The text itself is
shuffled once, into chunks of documents; only packed hashes move after that.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancewright.llm import repeats
from stancewright.llm.scratch import shuffle_partitions
from stancewright.llm.words import (
    PRIME,
    SECOND_BASE,
    mixed,
    prime_window_hashes,
    raw_texts,
    starts_inside,
    window_hashes,
    word_hashes,
)

CHUNK_BYTES = 2 << 20
#: A word and the blank after it; only sets how many buckets there are.
BYTES_PER_WORD = 6


class _Chunk:
    """Windows of the texts of one chunk: distinct keys by bucket, and where they start."""

    def __init__(self, group: pa.Table, window: int, buckets: int, base: int) -> None:
        self.rows = group.sort_by([("_key", "ascending"), ("_order", "ascending")])
        self.words = [t.split() for t in raw_texts(self.rows.column("_text"))]
        lengths = [len(w) for w in self.words]
        hashes = [word_hashes(w) for w in self.words]
        joined = np.concatenate([np.empty(0, np.uint64), *hashes])
        inside = starts_inside(lengths, window)[: max(0, len(joined) - window + 1)]
        self.starts = np.flatnonzero(inside)
        spread = window_hashes(joined, window, SECOND_BASE)[self.starts]
        keys = mixed(prime_window_hashes(joined, window, base)[self.starts])
        self.found = repeats.ChunkKeys(keys, spread, buckets)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])

    def covered(self, repeated: np.ndarray, window: int) -> np.ndarray:
        """Which words lie in a window whose key is marked."""
        edges = np.zeros(self.offsets[-1] + 1, np.int64)
        starts = self.starts[repeated[self.found.place]]
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + window, -1)
        return np.cumsum(edges[:-1]) > 0


def _emitter(window: int, buckets: int, base: int):
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary())])

    def emit(group: pa.Table) -> pa.Table:
        chunk = _Chunk(group, window, buckets, base)
        number = group.column("_chunk")[0].as_py()
        names, parts = chunk.found.parts()
        return pa.table(
            [[number] * len(names), names, [repeats.packed(chunk.found.keys[p]) for p in parts]], schema=schema
        )

    return emit


def _mark_shared(group: pa.Table) -> pa.Table:
    """For every chunk in a bucket: a bit per key, set where another chunk has the key."""
    flags = repeats.shared([repeats.unpacked(b) for b in group.column("keys").to_pylist()])
    return pa.table(
        {
            "chunk": group.column("chunk"),
            "bucket": group.column("bucket"),
            "marks": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()),
        }
    )


def _intervals(words: np.ndarray) -> list[dict]:
    """Runs of set flags as half-open word positions."""
    steps = np.diff(np.concatenate([[0], words.astype(np.int8), [0]]))
    return [
        {"start": int(a), "end": int(b)}
        for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1))
    ]


def _cutter(window: int, buckets: int, base: int, columns: list[str]):
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(docs: pa.Table, marks: pa.Table) -> pa.Table:
        chunk = _Chunk(docs, window, buckets, base)
        repeated = chunk.found.counts() > 1
        said = zip(chunk.found.ranges(marks.column("bucket").to_numpy()), marks.column("marks").to_pylist())
        for (a, b), blob in said:
            repeated[a:b] |= np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a).astype(bool)
        covered = chunk.covered(repeated, window)
        texts, n_removed, removed = [], [], []
        for words, a, b in zip(chunk.words, chunk.offsets[:-1], chunk.offsets[1:]):
            gone = covered[a:b]
            n_removed.append(int(gone.sum()))
            removed.append(_intervals(gone))
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if n_removed[-1] else words
            texts.append(b" ".join(kept))
        return pa.table(
            [chunk.rows.column(c) for c in columns]
            + [
                pa.array([len(w) for w in chunk.words], pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string()),
                pa.array(removed, spans),
            ],
            names=[*columns, "n_words", "n_removed", "kept_text", "removed"],
        )

    return cut


def remove_repeats(
    docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents without the words of windows that start more than once in the table.

    A window is ``window`` consecutive words of one document; windows are judged on the
    input as it is, not on what is left. Returned per row of ``docs``: the id, ``n_words``,
    ``n_removed``, ``kept_text`` (the other words, joined by one blank) and ``removed`` (the
    maximal intervals of removed words, ends exclusive). NULL and empty texts have no words
    and come back with an empty text; a text shorter than the window is kept; rows repeated
    in full lose all their windows, as each has a twin. An empty table gives an empty one.
    Other columns are not read.

    Two windows count as equal when a polynomial of their words modulo a prime near 2**61 agrees, at a
    base that is drawn in this call, and their bucket does. Windows that differ agree with a probability
    of at most ``window`` / 2**61 each pair, whatever the texts are.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    buckets = repeats.bucket_count(size // BYTES_PER_WORD)
    chunks = max(1, -(-size // CHUNK_BYTES))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"), text.alias("_text"),
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("_key"),
    )
    rows = rows.select(
        F.pmod("_key", F.lit(chunks)).alias("_chunk"), "_key",
        F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_order"), "_id", "_text",
    ).repartition(shuffle_partitions(docs), "_chunk")
    # Drawn anew for each table, and the same in all tasks: see ``prime_window_hashes``.
    base = (1 << 32) + secrets.randbelow(PRIME - (1 << 33))
    keys = rows.groupBy("_chunk").applyInArrow(
        _emitter(window, buckets, base), "chunk long, bucket long, keys binary"
    )
    marks = keys.groupBy("bucket").applyInArrow(
        _mark_shared, "chunk long, bucket long, marks binary"
    )
    kind = docs.schema[id_col].dataType.simpleString()
    # Both uses of ``rows`` have the same exchange, which Spark runs once.
    cut = rows.groupBy("_chunk").cogroup(marks.groupBy("chunk")).applyInArrow(
        _cutter(window, buckets, base, ["_id"]),
        f"_id {kind}, n_words long, n_removed long, kept_text string, "
        "removed array<struct<start:int,end:int>>",
    )
    return cut.withColumnRenamed("_id", id_col)
