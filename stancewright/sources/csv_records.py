"""CSV whose cells hold line breaks, read by many tasks a file.

Where a record ends cannot be seen from the middle of a file: a line break inside a quoted cell
belongs to the record. But the number of quotes before a line tells, as every cell opens and closes
with one and doubles those inside. So the quotes of each file slice are counted first; their sums
over the earlier slices of the file say whether a slice begins inside a cell. Then each slice is cut
into records where it lies, and only the pieces of records that span slices are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stancewright.schemas import col

#: Kinds of piece: a record in full, the beginning of one, and what continues one.
WHOLE, OPENS, CONTINUES = 0, 1, 2
CSV_OPTIONS = {"escape": '"', "multiLine": "true"}
_PIECES = pa.schema(
    [("record", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("header", pa.bool_())]
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the slice of the file that they begin in, in the order of the file inside a slice."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def _inside_a_cell(lines: DataFrame) -> DataFrame:
    """Slices that begin inside a quoted cell. A file that ends inside one fails the job.

    One row per slice of a file, as many as Spark lists on the driver to plan the scan.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    broken = F.raise_error(F.concat(F.lit("file ends inside a quoted cell: "), F.col("file"))).cast("boolean")
    ends_closed = F.sum("quotes").over(Window.partitionBy("file")) % 2 == 0
    return (
        counted.select("file", "block", F.sum("quotes").over(earlier).alias("before"), ends_closed.alias("closed"))
        .filter(F.when(F.col("closed"), F.col("before") % 2 == 1).otherwise(broken))
        .select("file", "block", F.lit(True).alias("open"))
    )


class _Slice:
    """Cuts the lines of one slice into pieces, batch by batch."""

    def __init__(self, file: str, block: int, inside: bool) -> None:
        self.file, self.block, self.inside = file, block, inside
        self.pending: list[str] = []
        # What comes before the first end of a record belongs to an earlier slice.
        self.continues, self.first = inside, block == 0

    def _piece(self, records: pa.Array, kind: int, header: bool) -> pa.RecordBatch:
        n = len(records)
        where = (self.file, self.block) if kind != WHOLE else (None, None)
        flags = np.zeros(n, bool)
        flags[:1] = header
        return pa.record_batch(
            [
                records, pa.array([where[0]] * n, pa.string()), pa.array([where[1]] * n, pa.int64()),
                pa.array(np.full(n, kind, np.int32)), pa.array(flags),
            ],
            schema=_PIECES,
        )

    def cut(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        inside = (np.cumsum(quotes) + self.inside) % 2 == 1
        ends = np.flatnonzero(~inside) + 1
        self.inside = bool(inside[-1])
        if len(ends) and (self.pending or self.continues):
            self.pending += lines[: ends[0]].to_pylist()
            yield from self.close(CONTINUES if self.continues else WHOLE)
            lines, ends = lines[ends[0] :], ends[1:] - ends[0]
        if len(ends):
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            records = pc.binary_join(pa.ListArray.from_arrays(offsets, lines[: ends[-1]]), "\n")
            yield self._piece(records, WHOLE, self.first)
            self.first = False
            lines = lines[ends[-1] :]
        self.pending += lines.to_pylist()

    def close(self, kind: int | None = None) -> Iterator[pa.RecordBatch]:
        """The record so far, or at the end of the slice the piece that is left."""
        if self.pending:
            text = pa.array(["\n".join(self.pending)], pa.string())
            yield self._piece(text, (CONTINUES if self.continues else OPENS) if kind is None else kind, self.first)
            self.first = False
        self.pending, self.continues = [], False


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Slice | None = None
    for batch in batches:
        block = batch.column("block").to_numpy()
        files = batch.column("file").dictionary_encode()
        number = files.indices.to_numpy()
        turns = 1 + np.flatnonzero((np.diff(block) != 0) | (np.diff(number) != 0))
        for a, b in zip([0, *turns], [*turns, batch.num_rows]):
            if a == b:
                continue
            file = files.dictionary[int(number[a])].as_py()
            if now is None or (now.file, now.block) != (file, block[a]):
                if now is not None:
                    yield from now.close()
                now = _Slice(file, int(block[a]), bool(batch.column("open")[a].as_py()))
            yield from now.cut(batch.column("value")[a:b])
    if now is not None:
        yield from now.close()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` and ``header`` (whether it is the first of its file) of the CSV files below a path.

    The text is scanned three times and never shuffled, but for pieces of records that span file
    slices, two a slice at most. Quotes may only open and close cells or be doubled inside a quoted
    one, as RFC 4180 has it.
    """
    lines = _lines(spark, path)
    # One row per file slice that begins inside a cell.
    starts = F.broadcast(_inside_a_cell(lines))
    placed = lines.join(starts, ["file", "block"], "left").select(
        "value", "file", "block", F.coalesce("open", F.lit(False)).alias("open")
    )
    pieces = placed.mapInArrow(_cut, "record string, file string, block long, kind int, header boolean")
    in_order = Window.partitionBy("file").orderBy("block", F.col("kind").desc())
    chain = F.sum((F.col("kind") == OPENS).cast("long")).over(in_order)
    glued = (
        pieces.filter(F.col("kind") != WHOLE).withColumn("chain", chain).groupBy("file", "chain")
        .agg(F.array_sort(F.collect_list(F.struct("block", (-F.col("kind")).alias("after"), "record"))).alias("parts"),
             F.some("header").alias("header"))
        .select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"), "header")
    )
    whole = pieces.filter(F.col("kind") == WHOLE).select("record", "header")
    return whole.unionByName(glued).withColumn("record", F.regexp_replace("record", r"\r\z", "")).filter("record != ''")


def _data_row(cells: Column, names: list[str]) -> Column:
    """False for a header that has the expected names; another header fails the job."""
    same = F.lit(True)
    for name in names:
        # Spark names cells that are empty by their place, and numbers repeated names.
        cell = F.regexp_replace(cells.getField(name), "^\ufeff", "")
        same = same & (cell.isNull() | F.startswith(F.lit(name), cell))
    differs = F.raise_error(F.concat(F.lit("a file has another header: "), F.col("record"))).cast("boolean")
    return F.when(~F.col("header"), True).when(same, False).otherwise(differs)


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text, each file read by as many tasks as it has slices.

    Gives the rows of Spark's own multi-line reader, which takes one task a file. All files need one
    header; a compressed file cannot be split.
    """
    names = spark.read.options(header=True, **CSV_OPTIONS).csv(path).columns
    ddl = ", ".join("`{}` STRING".format(n.replace("`", "``")) for n in names)
    cells = F.from_csv("record", F.lit(ddl), CSV_OPTIONS)
    rows = csv_records(spark, path).withColumn("cells", cells).filter(_data_row(F.col("cells"), names))
    return rows.select(*[F.col("cells").getField(n).alias(n) for n in names])
