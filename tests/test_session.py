from types import SimpleNamespace

import pytest

from stancewright.session import drop_scratch, materialise, scratch_path, shared_dir


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_the_configured_folder_wins():
    assert shared_dir(fake("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake("yarn"))


def test_a_local_session_may_use_a_temporary_folder():
    assert shared_dir(fake("local[2]")) == shared_dir(fake("local[2]"))


def test_scratch_paths_differ(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_materialise_cuts_the_lineage(spark, rows):
    df = materialise(spark.range(5).selectExpr("id * 2 AS id"))
    assert rows(df) == [(0,), (2,), (4,), (6,), (8,)]
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_scratch_tables_can_be_dropped(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert drop_scratch(spark, path) and not drop_scratch(spark, path)
    with pytest.raises(ValueError, match="not in the scratch folder"):
        drop_scratch(spark, "/tmp")
