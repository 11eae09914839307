"""Exact deduplication by sorting contents.

Rows are dealt by sampled splitters into ranges of (first bytes, digest, id), sorted within
their range, and each row is compared in full with its neighbour. Because the id is part
of the order, the copies of one text may span any number of ranges: a text that makes up a
third of all rows is spread like any other third. Runs that touch the edge of a range are
joined up from one row per edge.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancewright.llm.scratch import shuffle_partitions, unused, written

SPLITTER_BYTES = 16
_RUNS = (
    "id long, part int, run long, is_first boolean, is_last boolean, "
    "run_min long, run_max long, run_rows long, sha256 string, at_edge boolean, edge_text binary"
)


class _Run:
    """Consecutive rows with one text. Only the ids are held."""

    def __init__(self, number: int, text: bytes) -> None:
        self.number, self.text, self.ids = number, text, []


def _mark_runs(batches):
    """Rows of one sorted range, each with what is known of its run inside the range."""
    part = TaskContext.get().partitionId()
    schema = pa.schema(
        [("id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("is_first", pa.bool_()),
         ("is_last", pa.bool_()), ("run_min", pa.int64()), ("run_max", pa.int64()),
         ("run_rows", pa.int64()), ("sha256", pa.string()), ("at_edge", pa.bool_()), ("edge_text", pa.binary())]
    )
    block: list[tuple] = []

    def rows_of(run: _Run, at_edge: bool):
        known = [x for x in run.ids if x is not None]
        low, high = (min(known), max(known)) if known else (None, None)
        last = len(run.ids) - 1
        sha = hashlib.sha256(run.text).hexdigest()
        for i, x in enumerate(run.ids):
            text = run.text if at_edge and i in (0, last) else None
            yield (x, part, run.number, i == 0, i == last, low, high, len(run.ids), sha, at_edge, text)

    def full(least: int):
        nonlocal block
        if len(block) >= least:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema
            )
            block = []

    run: _Run | None = None
    for batch in batches:
        for x, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if run is None:
                run = _Run(0, text)
            elif text != run.text:
                block.extend(rows_of(run, run.number == 0))
                yield from full(10_000)
                run = _Run(run.number + 1, text)
            run.ids.append(x)
    if run is not None:
        block.extend(rows_of(run, True))
    yield from full(1)


def _joined_edges(runs: DataFrame) -> DataFrame:
    """For every run at the edge of its range: the whole run across ranges.

    The texts of neighbouring edges are compared by a join on the range number; what then
    remains is two narrow rows per range, that is per shuffle partition.
    """
    edge = runs.where("at_edge")
    first = edge.where("is_first and run = 0").select(
        F.col("part"), F.col("edge_text").alias("first_text")
    )
    last_run = F.max(F.struct("run", "is_last", "edge_text")).alias("x")
    last = edge.where("is_last").groupBy("part").agg(last_run).select(
        "part", F.col("x.edge_text").alias("last_text")
    )
    # Empty ranges hold no rows, so neighbours are neighbours among the others.
    order = Window.orderBy("part")
    ranges = edge.select("part").distinct().select("part", F.lag("part").over(order).alias("before"))
    goes_on = (
        first.join(ranges, "part")
        .join(last.withColumnRenamed("part", "before"), "before")
        .where(F.col("first_text") == F.col("last_text"))
        .select("part", F.lit(0).cast("long").alias("run"), F.lit(1).alias("goes_on"))
    )
    whole = edge.where("is_first").select("part", "run", "run_min", "run_max", "run_rows")
    chain = F.sum(F.when(F.col("goes_on").isNull(), 1).otherwise(0)).over(Window.orderBy("part", "run"))
    chained = whole.join(goes_on, ["part", "run"], "left").withColumn("chain", chain)
    over = Window.partitionBy("chain")
    return chained.select(
        "part", "run",
        F.min("run_min").over(over).alias("all_min"), F.max("run_max").over(over).alias("all_max"),
        F.sum("run_rows").over(over).alias("all_rows"),
        (F.row_number().over(over.orderBy("part", "run")) == 1).alias("heads"),
        (F.row_number().over(over.orderBy(F.desc("part"), F.desc("run"))) == 1).alias("tails"),
    )


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min"
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; NULL counts as empty. The row with the smallest
    (``keep='min'``) or largest id of equal texts is kept, and exactly one of them where that
    id is repeated. A NULL id loses to any other: it is kept only if its whole group has
    none, and ``keep_id`` is then NULL. An empty table gives an empty table; other columns
    are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    order = [F.substring("text", 1, SPLITTER_BYTES), F.xxhash64("text")]
    by_id = F.asc_nulls_last("id") if keep == "min" else F.asc_nulls_first("id")
    dealt = rows.repartitionByRange(shuffle_partitions(docs), *order, by_id)
    runs = written(
        dealt.sortWithinPartitions(*order, F.col("text"), by_id).mapInArrow(_mark_runs, _RUNS),
        "content-runs",
    )
    # At most two rows per range: bounded by the number of shuffle partitions.
    edges = F.broadcast(_joined_edges(runs))
    inside = F.col("all_rows").isNull()
    ends = ("is_first", "heads", "run_min", "all_min") if keep == "min" else ("is_last", "tails", "run_max", "all_max")
    at_end, of_chain, own, joint = ends
    return runs.join(edges, ["part", "run"], "left").select(
        F.col("id").alias(id_col),
        F.when(inside, F.col(own)).otherwise(F.col(joint)).alias("keep_id"),
        F.coalesce("all_rows", "run_rows").alias("group_size"),
        (F.col(at_end) & F.coalesce(of_chain, F.lit(True))).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min"
) -> DataFrame:
    """``docs`` without the copies, all columns as they were.

    Of rows that repeat both id and text one stays; rows that share an id but not the text
    are told apart by a digest of the text.
    """
    sha, kept_id, kept_sha = (unused(docs.columns, n) for n in ("_sha", "_kept_id", "_kept_sha"))
    digest = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)
    kept = mark_copies(docs, id_col, text_col, keep).where("kept").select(
        F.col(f"`{id_col}`").alias(kept_id), F.col("text_sha256").alias(kept_sha)
    )
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha))
    left = docs.withColumn(sha, digest).join(kept, same, "left_semi")
    return left.dropDuplicates([id_col, sha]).drop(sha)
