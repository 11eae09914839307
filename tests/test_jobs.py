"""Whole jobs, from labelled sheet to report."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from stancewright import schemas, sources
from stancewright.operators import embed, train
from stancewright.plans.classify import (
    classify_posts,
    predict_from_embedding,
    predict_from_text,
    result_view,
)
from stancewright.plans.embedding_store import build_store, extend_store
from stancewright.plans.report_page import evaluate_against_labels, report_page
from stancewright.streaming import (
    first_arrivals,
    read_arrivals,
    read_batches,
    read_stream,
    run_to_end,
    score_raw_stream,
    score_stream,
    stance_stream,
)


@pytest.fixture(scope="module")
def sheet(spark):
    """Labelled posts: every label a function of the key, embeddings from the test tables."""
    store = spark.read.parquet(f"{SF}/embeddings.parquet")
    flags = [
        (F.hash(F.lit(name), "vec_id") % 3 == 0).cast("int").alias(name)
        for name in schemas.BINARY_LABELS
    ]
    return store.select(
        F.concat(F.lit("https://h/"), "vec_id").alias("permalink"),
        F.col("vec_id").cast("string").alias("code"),
        F.concat(F.lit("post number "), "vec_id").alias("post"),
        F.lit("u").alias("user"), F.lit(None).cast("string").alias("username"),
        F.date_add(F.lit("2023-01-01"), F.col("vec_id").cast("int")).cast("string").alias("date"),
        *flags,
    ).cache()


@pytest.fixture(scope="module")
def store(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("code"), "embedding"
    )


@pytest.fixture(scope="module")
def models(spark, store):
    data = store.withColumns(
        {"RSF": F.col("code").cast("int") % 3, "Sudanese": F.col("code").cast("int") % 2}
    )
    return train.train_labels(data, ["RSF", "Sudanese"], max_iter=5)


def test_predict_from_embedding(sheet, store, models):
    preds = predict_from_embedding(sheet, store, models)
    kept = sheet.filter("`Not about Sudan` = 0 and `Not Sudanese` = 0").count()
    assert preds.count() == 2 * kept
    assert preds.filter("ground_truth is null").count() == 0
    assert result_view(preds).count() == 2 * kept
    assert result_view(preds, unmerge=True, three_state=["RSF"]).count() == 3 * kept


def test_strict_prediction_fails_without_embedding(sheet, store, models):
    with pytest.raises(Exception, match="no embedding"):
        predict_from_embedding(sheet, store.limit(3), models).collect()


def test_report(sheet, store, models, spark):
    classified = classify_posts(sheet.drop("RSF"), store, models, ["RSF"])
    assert classified.count() == 500 and {"pro RSF", "anti RSF"} <= set(classified.columns)
    scores = spark.createDataFrame(
        [("RSF", "0.9±0.1", "0.8±0.1", "0.7±0.1", "0.6±0.1", "0.5±0.1", "0.4±0.1")], schemas.SCORES
    )
    tables = report_page(classified, sheet, scores)
    assert tables["prevalence"].count() == 16
    assert tables["by_month"].count() == 12 * 16
    assert tables["months"].count() == 13
    assert tables["scores"].count() == 4
    assert tables["evaluation"].count() == 17
    untouched = tables["evaluation"].filter("label = 'pro war'").first()
    assert untouched["accuracy"] == 1.0 and untouched["f1"] == 1.0
    march = report_page(classified, month=3, only=["pro war"])["by_month"].collect()
    assert [r["label"] for r in march] == ["pro war"]


def test_demo_labels_fill_the_report(sheet, store, models):
    fitted = {
        label: models["RSF" if label in schemas.THREE_STATE_LABELS else "Sudanese"]
        for label in schemas.DEMO_LABELS
    }
    classified = classify_posts(sheet.select("code", "post", "date"), store, fitted)
    assert set(schemas.BINARY_LABELS) < set(classified.columns)
    assert report_page(classified, sheet)["evaluation"].count() == 17


def test_evaluation_needs_every_post(sheet):
    with pytest.raises(Exception, match="no prediction for code"):
        evaluate_against_labels(sheet.filter("code <> '7'"), sheet).collect()


def test_predict_from_text(spark, models):
    posts = spark.createDataFrame([("a", "Stop the war")], "code string, post string")
    preds = predict_from_text(posts, models, dim=64).collect()
    assert sorted(r["label"] for r in preds) == ["RSF", "Sudanese"]
    assert all(r["ground_truth"] is None for r in preds)


def test_embedding_store(spark, tmp_path):
    def lengths():
        return lambda texts: [[float(len(t))] for t in texts]

    posts = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "yy")], "code string, post string")
    path = str(tmp_path / "store")
    build_store(posts.filter("code = 'a'"), path, lengths)
    extend_store(spark, posts, path, lengths)
    extend_store(spark, posts, path, lengths)
    got = sorted((r["code"], r["embedding"]) for r in sources.read_embeddings(spark, path).collect())
    assert got == [("a", [1.0]), ("b", [2.0])]
    assert embed.embedding_dim(sources.read_embeddings(spark, path)) == 1


def test_stream_equals_batch(spark, store, models, tmp_path, rows):
    folder = str(tmp_path / "in")
    store.repartition(3).write.parquet(folder)
    stream = read_stream(spark, folder, store.schema, maxFilesPerTrigger=1)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "offsets")
    run_to_end(score_stream(stream, models), out, checkpoint)
    batch = train.predict_labels(store, models)
    assert rows(spark.read.parquet(out), "code", "label", "prediction") == rows(batch, "code", "label", "prediction")
    # A second run picks up only what is new.
    store.limit(1).write.mode("append").parquet(folder)
    run_to_end(score_stream(read_stream(spark, folder, store.schema), models), out, checkpoint)
    assert spark.read.parquet(out).count() == batch.count() + 2


def test_unfolded_stream(spark, store, models, tmp_path):
    folder = str(tmp_path / "in")
    store.write.parquet(folder)
    stream = score_stream(read_stream(spark, folder, store.schema), models, three_state=["RSF"])
    run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "offsets"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500 * 3


def test_stream_of_texts(spark, models, tmp_path, rows):
    posts = spark.createDataFrame(
        [(str(i), f"stop the war {i}") for i in range(20)], "code string, post string"
    )
    posts.write.parquet(str(tmp_path / "in"))
    stream = predict_from_text(read_stream(spark, str(tmp_path / "in"), posts.schema), models, dim=64)
    run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "offsets"))
    batch = predict_from_text(posts, models, dim=64)
    columns = ("code", "label", "prediction")
    assert rows(spark.read.parquet(str(tmp_path / "out")), *columns) == rows(batch, *columns)


def test_stance_stream(spark, tmp_path, rows):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 1.0)], "p double, a double")
    df.write.parquet(str(tmp_path / "in"))
    stream = stance_stream(read_stream(spark, str(tmp_path / "in"), df.schema), {"t": ("p", "a")})
    run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "offsets"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "t") == [(1,), (2,)]


def test_raw_stream_survives_a_crash(spark, tmp_path, rows):
    """A batch dies after its vectors are stored; the next run replays it, and nothing is there twice."""
    raw = spark.range(60).select(
        F.col("id").cast("string").alias("code"), F.concat(F.lit("post about "), F.col("id") % 7).alias("post")
    )
    vectors = embed.embed_text(raw, "hashing", dim=16).withColumn("x", F.col("code").cast("int") % 2)
    models = train.train_labels(vectors, ["x"], max_iter=3)
    arriving, preds, store, offsets = (str(tmp_path / n) for n in ("in", "preds", "store", "offsets"))
    for a, b in ((0, 20), (20, 40), (40, 60), (0, 60)):
        part = raw.filter(f"int(code) >= {a} and int(code) < {b}").coalesce(1)
        sources.write_posts(part, arriving, mode="append")
    crash = tmp_path / "crash"
    crash.touch()

    class Failing(dict):
        """Models that are gone in the second batch."""

        def values(self):
            if crash.exists() and (tmp_path / "store" / "batch=1").exists():
                raise ConnectionError("driver lost")
            return super().values()

    def run(fitted):
        stream = first_arrivals(read_arrivals(spark, arriving, raw.schema, maxFilesPerTrigger=1))
        score_raw_stream(stream, fitted, "hashing", preds, store, offsets, dim=16)

    with pytest.raises(Exception, match="driver lost"):
        run(Failing(models))
    assert read_batches(spark, store).count() == 40 and read_batches(spark, preds).count() == 20
    crash.unlink()
    run(models)
    expected = predict_from_text(raw, models, "hashing", dim=16)
    assert rows(read_batches(spark, preds), "code", "prediction") == rows(expected, "code", "prediction")
    assert read_batches(spark, store).count() == 60
    before = read_batches(spark, preds).count()
    run(models)
    assert read_batches(spark, preds).count() == before


def test_repeated_codes_are_dropped_within_the_delay(spark, tmp_path):
    folder, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    rows = [("a", "2023-01-01 00:00:00"), ("a", "2023-01-01 01:00:00"), ("b", "2023-01-01 02:00:00"), (None, "2023-01-01 03:00:00")]
    posts = spark.createDataFrame(rows, "code string, at string").withColumn("at", F.to_timestamp("at"))
    sources.write_posts(posts, folder)
    stream = first_arrivals(read_stream(spark, folder, posts.schema), arrived="at")
    run_to_end(stream, out, offsets)
    assert sorted(r[0] or "" for r in spark.read.parquet(out).select("code").collect()) == ["", "a", "b"]
