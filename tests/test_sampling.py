import hashlib
import math

import pytest
from pyspark.sql import functions as F

from stancewright.operators import sampling


@pytest.fixture
def posts(spark):
    return spark.range(1000).select(
        F.col("id").cast("string").alias("code"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(1).alias("y"),
    )


def test_key_split(posts, rows):
    split = sampling.split_by_key(posts)
    for code, name in rows(split, "code", "split")[:50]:
        digest = hashlib.md5(f"42:{code}".encode()).hexdigest()
        edge = int(digest[:8], 16) / 2**32
        assert name == ("train" if edge < 0.7 else "val" if edge < 0.91 else "test")
    assert rows(split.repartition(13)) == rows(split)
    assert rows(sampling.split_by_key(posts, seed=1)) != rows(split)
    assert sum(n for _, n in rows(sampling.split_sizes(split))) == 1000


def test_split_weights_are_checked(posts, rows):
    with pytest.raises(ValueError):
        sampling.split_by_key(posts, weights={"a": 0.5, "b": 0.6})
    assert rows(sampling.split_sizes(sampling.split_by_key(posts, weights={"all": 1.0}))) == [("all", 1000)]


@pytest.mark.parametrize("n", [1, 7, 100, 999])
def test_exact_split(spark, rows, n):
    df = spark.range(n).withColumnRenamed("id", "code")
    sizes = dict(rows(sampling.split_sizes(sampling.split_exact(df))))
    held = math.ceil(0.3 * n)
    test = math.ceil(0.3 * held)
    expected = {"train": n - held, "val": held - test, "test": test}
    assert sizes == {k: v for k, v in expected.items() if v}


def test_folds_are_balanced_within_classes(posts, rows):
    folds = sampling.stratified_folds(posts, "y", 4)
    sizes = rows(folds.groupBy("y", "fold").count())
    assert len(sizes) == 8
    for y in (0, 1):
        counts = [n for cls, _, n in sizes if cls == y]
        assert max(counts) - min(counts) <= 1
    assert rows(folds.repartition(5)) == rows(folds)
    assert folds.columns == ["code", "y", "fold"]


def test_class_weights(spark, rows):
    df = spark.createDataFrame([(0, 1), (0, 1), (2, 1), (None, 1)], "a int, b int")
    got = rows(sampling.class_weights(df, ["a", "b"]))
    assert got == [("a", 0, 2, 0.75), ("a", 2, 1, 1.5), ("b", 1, 4, 1.0)]
    # Weighted rows add up to the number of rows.
    for label, n in (("a", 3), ("b", 4)):
        assert sum(r[2] * r[3] for r in got if r[0] == label) == pytest.approx(n)
    assert rows(sampling.n_classes(df, ["a", "b"])) == [("a", 2), ("b", 1)]


def test_pos_weights(spark, rows):
    df = spark.createDataFrame([(1, 0, None), (0, 0, None), (None, 0, None)], "a int, b int, c int")
    assert rows(sampling.pos_weights(df, ["a", "b", "c"])) == [
        ("a", pytest.approx(2 / 1.00001)), ("b", pytest.approx(3 / 1e-5)), ("c", pytest.approx(3 / 1e-5)),
    ]


def test_training_frame(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 0), ("b", [3.0, 4.0], None)], "code string, embedding array<float>, y int")
    row = sampling.training_frame(df, "y", weights=[(0, 0.5), (1, 2.0)]).collect()
    assert len(row) == 1 and row[0]["weight"] == 0.5 and list(row[0]["features"]) == [1.0, 2.0]


def test_a_repeated_key_has_no_rank(spark):
    from stancewright.operators.ordering import with_hash_rank

    df = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "code string, x int")
    with pytest.raises(Exception, match="code is not unique: a"):
        with_hash_rank(df, "code", 1).collect()
    # Once in each stratum is once.
    assert with_hash_rank(df, "code", 1, ["x"]).count() == 3
    missing = spark.createDataFrame([(None, 1), (None, 1), ("b", 1)], "code string, x int")
    with pytest.raises(Exception, match="code is not unique: NULL"):
        with_hash_rank(missing, "code", 1).collect()
