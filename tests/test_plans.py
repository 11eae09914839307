"""The physical plans: what is pushed down, what is shuffled, what never appears."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF
from stancewright.catalog import QUERIES
from stancewright.operators import clean, keys, metrics, report, sampling, train

TRAINED = {
    "train_and_score", "cross_validation", "predict_coverage", "epoch_log", "classified_posts",
    "text_classifier", "training_frame", "stream_scores", "stream_raw_posts", "pca_project",
    "predict_stacked",
}
PYTHON = {"embed_with_function", "posts_csv_round_trip"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", plan(df)))


@pytest.fixture
def no_broadcast(spark):
    """Joins as they run when both sides are large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_no_cross_join_and_no_python(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text
    assert ("MapInArrow" in text) == (name in PYTHON)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_single_task_steps_only_see_aggregates(spark, no_broadcast, name):
    """A single-partition exchange may only follow an aggregate of bounded size."""
    lines = plan(QUERIES[name](spark, SF)).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = [x for x in lines[i + 1 :] if "Aggregate" in x or "FileScan" in x or "Scan Existing" in x]
            assert below and "Aggregate" in below[0], line


def test_scan_reads_only_the_needed_columns(spark):
    posts = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(report.label_counts(posts.withColumn("x", F.col("n_chars") % 2), ["x"]))
    assert "ReadSchema: struct<n_chars:bigint>" in text


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet(f"{SF}/labels.parquet")
    text = plan(report.label_counts(rows.filter("toxic = 0"), ["quality"]))
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,0)]" in text


def test_prevalence_is_one_aggregate(spark):
    rows = spark.read.parquet(f"{SF}/labels.parquet")
    prevalence = report.label_prevalence(rows, ["quality", "toxic"])
    assert shuffles(prevalence) == 0 and "Window" not in plan(prevalence)


def test_key_split_does_not_shuffle(spark):
    assert shuffles(sampling.split_by_key(spark.range(10).withColumnRenamed("id", "code"))) == 0


def test_strict_lookup_moves_the_vectors_once(spark, no_broadcast):
    store = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "code")
    posts = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("doc_id", "code").filter("code < 500")
    text = plan(keys.attach_embeddings(posts, store, strict=True))
    scans = re.findall(r"ReadSchema: struct<[^\n]*", text)
    assert sum("embedding" in x for x in scans) == 1


def test_strict_lookup_of_few_posts_does_not_move_the_store(spark):
    store = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "code")
    posts = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("doc_id", "code").filter("code < 500")
    assert "SortMergeJoin" not in plan(keys.attach_embeddings(posts, store, strict=True))


@pytest.fixture
def tiny_skew(spark, no_broadcast):
    """Skew handling that already sets in at test size."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def hot_posts(spark, n=30_000):
    """A third of the rows share one key; several map tasks, as a split needs them."""
    code = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    return spark.range(0, n, 1, 8).select(code.alias("code"), F.lit(1).alias("a"), F.uuid().alias("post"))


def test_a_hot_key_is_split(spark, tiny_skew):
    store = spark.range(0, 30_000, 1, 4).select(F.col("id").alias("code"), F.lit(1.0).alias("embedding"))
    fixes = spark.range(0, 20_000, 1, 4).select(
        F.col("id").alias("code"), F.lit("a").alias("column"), F.lit(0).alias("value")
    )
    posts = hot_posts(spark)
    for df, n in (
        (keys.attach_embeddings(posts, store), 30_000),
        (keys.attach_embeddings(posts, store, strict=True), 30_000),
        (keys.pick_rows(posts, store), 30_000),
        (clean.apply_corrections(posts, fixes, ["a"]), 30_000),
    ):
        assert len(df.collect()) == n
        assert "skew=true" in plan(df), plan(df)


def test_small_key_sets_leave_the_large_side_in_place(spark):
    store = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "code")
    posts = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("doc_id", "code")
    picked = keys.wanted_rows(store, posts)
    # The one shuffle is that of the distinct keys.
    assert shuffles(picked) == 1 and "BroadcastHashJoin" in plan(picked)


def test_folds_shuffle_wide_rows_once(spark, no_broadcast):
    rows = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("doc_id", "code")
    text = plan(sampling.stratified_folds(rows, "quality", 5))
    wide = [x for x in text.splitlines() if "Exchange" in x and "_stratum" in x and "_slice" in x]
    # Rows for the rank, counts, and the few slice starts.
    assert len(wide) == 3


def test_bucketed_tables_join_without_a_shuffle(spark, no_broadcast, tmp_path):
    from stancewright import sources

    posts = spark.range(100).select(F.col("id").alias("code"), F.lit("p").alias("post"))
    store = spark.range(100).select(F.col("id").alias("code"), F.lit(1.0).alias("embedding"))
    try:
        sources.save_bucketed(posts, "bucketed_posts", buckets=4, path=str(tmp_path / "posts"))
        sources.save_bucketed(store, "bucketed_store", buckets=4, path=str(tmp_path / "store"))
        joined = keys.attach_embeddings(spark.table("bucketed_posts"), spark.table("bucketed_store"))
        assert joined.count() == 100 and shuffles(joined) == 0
    finally:
        for name in ("bucketed_posts", "bucketed_store"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_each_model_is_applied_once(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "code")
    models = train.train_labels(data, ["label"], max_iter=2)
    text = plan(train.predict_labels(data, models))
    assert shuffles(train.predict_labels(data, models)) == 0
    assert text.count("UDF(embedding") == 1


def test_binary_evaluation_has_one_aggregate_over_the_rows(spark):
    df = spark.createDataFrame([(1, 0, 1, 1)], "a int, b int, pa int, pb int")
    counts = metrics.confusion_wide(df, {"a": ("a", "pa"), "b": ("b", "pb")})
    text = plan(metrics.binary_scores(counts))
    assert shuffles(counts) == 0 and text.index("Generate") < text.index("HashAggregate")


def test_scoring_applies_the_models_once(spark):
    """The plan of the scores starts from stored predictions: no model, no vector in it."""
    data = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "code")
    models = train.train_labels(data, ["label"], max_iter=2)
    text = plan(train.score_models(data, models))
    assert "UDF(" not in text and "FileScan" not in text


def test_cross_validation_stores_what_it_scores(spark):
    from stancewright.plans.training import cross_validate

    data = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "code")
    text = plan(cross_validate(data, "label", k=2, max_iter=2))
    assert "UDF(" not in text and "FileScan" not in text and "InMemory" not in text


def test_only_texts_of_new_posts_move(spark, no_broadcast):
    from stancewright.operators import embed

    posts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    store = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    text = plan(embed.embed_missing(posts, store, "hashing", "text", "doc_id"))
    # The anti join on keys is below the only exchange of texts.
    assert "LeftSemi" in text and "LeftAnti" not in text.split("LeftSemi")[0]


def test_an_embedder_is_in_the_plan_of_a_strict_lookup_once(spark):
    from stancewright.operators import embed

    posts = spark.createDataFrame([("a", "x"), ("b", "y")], "code string, post string")
    vectors = embed.embed_text(posts, lambda: lambda texts: [[1.0] for _ in texts])
    assert plan(keys.attach_embeddings(posts, vectors, strict=True)).count("MapInArrow") == 1


def test_positions_sort_only_keys_once(spark, no_broadcast, monkeypatch):
    from stancewright.operators import ordering

    seen = []
    monkeypatch.setattr(ordering, "materialise", lambda df: seen.append(df) or df)
    ordering.with_position(spark.range(100).withColumnRenamed("id", "code"), "code")
    assert len(re.findall(r"Exchange ", plan(seen[0]))) == 1 and "Window" not in plan(seen[0])


def test_stacked_scores_are_one_node(spark):
    data = spark.createDataFrame([(i, [float(i % 5), 1.0], i % 2, i % 3) for i in range(60)], "code long, embedding array<float>, a int, b int")
    models = train.train_labels(data, ["a", "b"], max_iter=2)
    text = plan(train.predict_stacked(data, models))
    assert text.count("MapInArrow") == 1 and "UDF" not in text


def test_all_scores_from_one_reading(spark, no_broadcast, tmp_path):
    spark.createDataFrame(
        [("a", i % 3, i % 2, [0.2, 0.3, 0.5]) for i in range(50)],
        "label string, ground_truth int, prediction int, probs array<double>",
    ).write.parquet(str(tmp_path / "preds"))
    scores = metrics.evaluate(spark.read.parquet(str(tmp_path / "preds")))
    scores.collect()
    text = scores._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert final.count("Scan parquet") == 1 and "ReusedExchange" in final
