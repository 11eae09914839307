"""An embedding store that several jobs extend at once.

Rows lie in parts, folders of one Parquet table bucketed by key, so that the store is joined where it
lies. A version names the parts that count. It is written by creating a numbered file that must not
exist yet: of two jobs that extend the same version one succeeds, and the other drops the keys that
the first has added and tries again, without computing its vectors anew. What a failed job has
written is in no version and never read.

The file system has to refuse to create a file that exists, at once for all writers, as HDFS does.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancewright.session import drop_path, list_names, make_folder, read_small, write_new



def _table(path: str) -> str:
    return "store_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def _versions(path: str) -> str:
    return f"{path.rstrip('/')}/versions"


def _version_file(path: str, number: int) -> str:
    return f"{_versions(path)}/{number:012d}.json"


def _latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest version."""
    names = [n for n in list_names(spark, _versions(path)) if n.endswith(".json")]
    if not names:
        raise FileNotFoundError(f"no embedding store at {path}")
    number = max(int(n.removesuffix(".json")) for n in names)
    return number, json.loads(read_small(spark, _version_file(path, number)))


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Whether this job was the one to write the version."""
    return write_new(spark, _version_file(path, number), json.dumps(content))


def create_store(spark: SparkSession, path: str, buckets: int = 200) -> None:
    """An empty store; its number of buckets is that of the tasks of a join with it, and stays."""
    make_folder(spark, f"{path.rstrip('/')}/parts")
    if not _commit(spark, path, 1, {"buckets": buckets, "parts": []}):
        raise FileExistsError(f"there is an embedding store at {path}")


def _opened(spark: SparkSession, path: str, buckets: int) -> str:
    """Name of the table of all parts in this session's catalog."""
    name = _table(path)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (code STRING, embedding ARRAY<FLOAT>, error STRING, part STRING) "
        f"USING parquet PARTITIONED BY (part) CLUSTERED BY (code) SORTED BY (code) INTO {buckets} BUCKETS "
        f"LOCATION '{path.rstrip('/')}/parts'"
    )
    # Parts that other sessions have written.
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def _rows(spark: SparkSession, path: str, content: dict, parts: list[str] | None = None) -> DataFrame:
    parts = content["parts"] if parts is None else parts
    return spark.table(_opened(spark, path, content["buckets"])).filter(F.col("part").isin(parts)).drop("part")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``code`` and ``embedding`` of the newest version, one row per code.

    A join on ``code`` moves the other side only.
    """
    _, content = _latest(spark, path)
    return _rows(spark, path, content).filter("error is null").select("code", "embedding")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``code`` and ``error`` of what could not be embedded and has not been since."""
    _, content = _latest(spark, path)
    rows = _rows(spark, path, content)
    done = rows.filter("error is null").select("code")
    return rows.filter("error is not null").join(done, "code", "left_anti").groupBy("code").agg(F.max("error").alias("error"))


def known_codes(spark: SparkSession, path: str, with_rejects: bool = True) -> DataFrame:
    _, content = _latest(spark, path)
    rows = _rows(spark, path, content)
    return (rows if with_rejects else rows.filter("error is null")).select("code")


def _write_part(spark: SparkSession, path: str, content: dict, rows: DataFrame) -> str:
    part = uuid.uuid4().hex
    name = _opened(spark, path, content["buckets"])
    # Laid out by bucket first, so that a part has one file per bucket.
    rows.select("code", "embedding", "error").repartition(content["buckets"], "code").withColumn(
        "part", F.lit(part)
    ).write.insertInto(name)
    return part


def _drop_part(spark: SparkSession, path: str, part: str) -> None:
    drop_path(spark, f"{path.rstrip('/')}/parts/part={part}")


def add_rows(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Adds the rows whose code the store lacks; of several rows of a code, one.

    ``rows`` has ``code``, ``embedding`` and, if any could not be embedded, ``error``. It is computed
    once, whatever other jobs do meanwhile. A row with an error counts only while the code has no other.
    """
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    one = rows.groupBy("code").agg(F.min_by(F.struct("embedding", "error"), F.coalesce("error", F.lit(""))).alias("r"))
    pending, staged = one.select("code", "r.embedding", "r.error"), None
    while True:
        number, content = _latest(spark, path)
        stored = _rows(spark, path, content)
        known = stored.filter("error is null").select("code")
        fresh = pending.join(known, "code", "left_anti")
        part = _write_part(spark, path, content, fresh)
        if staged is not None:
            _drop_part(spark, path, staged)
        if _commit(spark, path, number + 1, {**content, "parts": [*content["parts"], part]}):
            return
        pending, staged = _rows(spark, path, content, [part]), part


def compact_store(spark: SparkSession, path: str) -> bool:
    """Puts all rows into one part. False if another job has extended the store meanwhile: then nothing changes.

    The old parts stay for jobs that are reading them.
    """
    number, content = _latest(spark, path)
    rows = _rows(spark, path, content)
    best = F.min_by(F.struct("embedding", "error"), F.coalesce("error", F.lit(""))).alias("r")
    one = rows.groupBy("code").agg(best).select("code", "r.embedding", "r.error")
    part = _write_part(spark, path, content, one)
    if _commit(spark, path, number + 1, {**content, "parts": [part]}):
        return True
    _drop_part(spark, path, part)
    return False
