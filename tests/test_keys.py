import pytest
from pyspark.sql import functions as F

from stancewright.operators import keys, ordering


@pytest.fixture
def posts(spark):
    return spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "code string, post string")


@pytest.fixture
def store(spark):
    return spark.createDataFrame(
        [("a", "x", [1.0]), ("b", "Y", [2.0]), ("c", "z", [3.0])],
        "code string, post string, embedding array<float>",
    )


def test_attach(posts, store, rows):
    assert rows(keys.attach_embeddings(posts, store), "code", "embedding") == [
        ("a", [1.0]), ("b", [2.0]), ("c", [3.0]),
    ]
    some = store.filter("code <> 'b'")
    assert rows(keys.attach_embeddings(posts, some), "code") == [("a",), ("c",)]
    assert keys.attach_embeddings(posts, store, strict=True).count() == 3
    # Nothing has to be read from the join: no consumer can remove the check.
    with pytest.raises(LookupError, match="no embedding for code .'b'"):
        keys.attach_embeddings(posts, some, strict=True)
    with pytest.raises(LookupError, match="more than one embedding for code .'a'"):
        keys.attach_embeddings(posts, store.union(store.filter("code = 'a'")), strict=True)
    extra = store.union(store.selectExpr("'zz'", *store.columns[1:])).union(store.selectExpr("'zz'", *store.columns[1:]))
    assert keys.attach_embeddings(posts, extra, strict=True).count() == 3


def test_strict_fails_on_a_null_key(spark, store):
    posts = spark.createDataFrame([(None,)], "code string")
    with pytest.raises(LookupError, match="no embedding for code .None"):
        keys.attach_embeddings(posts, store, strict=True)


def test_missing_keys(posts, store, rows):
    assert rows(keys.missing_keys(posts.union(posts), store.filter("code = 'a'"))) == [("b",), ("c",)]


def test_verify_text(posts, store, rows):
    assert rows(keys.verify_text(posts, store), "code") == [("b",), ("c",)]
    assert keys.verify_text(store, store).count() == 0
    absent = keys.verify_text(posts, store.filter("code <> 'a'"))
    assert rows(absent, "code", "in_store") == [("a", False), ("b", True), ("c", True)]
    with pytest.raises(LookupError, match="for code"):
        keys.verify_text(posts, store, strict=True)
    keys.verify_text(store, store, strict=True)


def test_unique(posts):
    assert keys.assert_unique(posts) is posts
    with pytest.raises(ValueError, match="not unique"):
        keys.assert_unique(posts.union(posts))


def test_align(spark, rows):
    truth = spark.createDataFrame([("a", 1), ("b", 0)], "code string, war int")
    preds = spark.createDataFrame([("a", 0), ("z", 1)], "code string, war int")
    assert rows(keys.align_predictions(truth, preds, ["war"], strict=False)) == [
        ("a", 1, 0), ("b", 0, None),
    ]
    with pytest.raises(LookupError, match="no prediction for code .'b'"):
        keys.align_predictions(truth, preds, ["war"])


def test_pick(posts, rows):
    assert rows(keys.pick_rows(posts, ["a", "q"]), "code") == [("a",)]
    twice = posts.filter("code = 'b'").union(posts.filter("code = 'b'"))
    assert rows(keys.pick_rows(posts, twice), "code") == [("b",)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_sequential_code(spark, partitions):
    ids = [(i * 7919) % 5000 for i in range(1200)]
    df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(partitions)
    got = {r["k"]: r["code"] for r in keys.with_sequential_code(df, "k").collect()}
    expected = {k: f"TW{i:03d}" for i, k in enumerate(sorted(ids))}
    assert got == expected


def test_position_needs_a_unique_key(spark):
    df = spark.range(500).union(spark.range(1))
    with pytest.raises(Exception, match="id is not unique: 0"):
        ordering.with_position(df, "id")


def test_position_needs_a_key(spark):
    with pytest.raises(Exception, match="id is NULL"):
        ordering.with_position(spark.range(5).union(spark.sql("SELECT CAST(NULL AS BIGINT)")), "id")


def test_position_over_text_keys(spark):
    words = [f"w{i}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "k string")
    got = {r["k"]: r["position"] for r in ordering.with_position(df, "k").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def test_hash_rank_ranks_rows_of_a_null_stratum(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"))
    ranked = ordering.with_hash_rank(df, "id", 1, ["s"])
    per = ranked.groupBy("s").agg(
        F.min("hash_rank"), F.max("hash_rank"), F.countDistinct("hash_rank"), F.max("hash_rank_total")
    )
    assert {tuple(r)[1:] for r in per.collect()} == {(0, 99, 100, 100)}
