"""Session settings and the shared scratch area."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks.

    On a cluster the caller brings the session; nothing in the library depends
    on the values set here.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stancewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@functools.cache
def _local_fallback() -> str:
    return tempfile.mkdtemp(prefix="stancewright-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_fallback()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, then read back by every consumer."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def _located(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop_path(spark: SparkSession, path: str) -> bool:
    fs, target = _located(spark, path)
    return fs.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _located(spark, path)
    fs.mkdirs(target)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, target = _located(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def read_small(spark: SparkSession, path: str) -> str:
    """Content of a file of a few kilobytes."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode()


def write_new(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a small file unless there is one; False if there is.

    The file appears with its content, by a rename that does not replace.
    """
    fs, target = _located(spark, path)
    gateway, hadoop = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop.fs
    _, draft = _located(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    kind = getattr(hadoop, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = getattr(kind, "NONE")
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Exception:
        fs.delete(draft, False)
        if fs.exists(target):
            return False
        raise
    return True


def drop_scratch(spark: SparkSession, path: str) -> bool:
    """Removes one scratch table, once what was made from it is stored elsewhere."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is not in the scratch folder")
    return drop_path(spark, path)
