import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from stancewright import sources
from stancewright.operators import metrics, train
from stancewright.plans.training import cross_validate, train_and_test, train_epochs


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("vec_id").alias("code"), "embedding",
        (F.col("label") % 3).alias("RSF"), (F.col("label") > 6).cast("int").alias("Sudanese"),
        F.lit(0).alias("Not about Sudan"),
    ).cache()


@pytest.fixture(scope="module")
def models(data):
    return train.train_labels(data, ["RSF", "Sudanese", "Not about Sudan"], max_iter=20)


def test_layers():
    assert train.mlp_layers(3072, 4096, 3) == [3072, 4096, 2048, 1024, 512, 3]


def test_predictions(data, models):
    preds = train.predict_labels(data, models)
    assert preds.count() == 500 * 3
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    assert preds.filter(F.abs(total - 1) > 1e-9).count() == 0
    assert preds.filter(F.col("prob") != F.array_max("probs")).count() == 0
    majority = 0.4
    scores = {r["label"]: r for r in metrics.evaluate(preds).collect()}
    assert scores["RSF"]["accuracy"] > majority and scores["RSF"]["n_classes"] == 3
    assert scores["Sudanese"]["roc_auc_scores"] > 0.6
    assert scores["Not about Sudan"]["roc_auc"] is None


def test_predictions_without_labels(data, models):
    preds = train.predict_labels(data.select("code", "embedding"), models)
    assert preds.filter("ground_truth is not null").count() == 0


def test_wide_predictions_agree_with_long(data, models, rows):
    wide = train.predict_wide(data, models, ["RSF"])
    assert set(wide.columns) == {
        "code", "embedding", "RSF", "pro RSF", "anti RSF", "Sudanese", "Not about Sudan",
    }
    long = train.predict_labels(data, models).filter("label = 'RSF'")
    pro = long.filter("prediction = 1").count()
    assert wide.agg(F.sum("pro RSF")).first()[0] == pro


def test_models_survive_saving(data, models, rows, tmp_path):
    root = str(tmp_path / "models")
    sources.save_models(models, root, split=3)
    back = sources.load_models(root, list(models), split=3)
    before, after = train.predict_labels(data, models), train.predict_labels(data, back)
    assert rows(before, "code", "label", "prob") == rows(after, "code", "label", "prob")
    assert "label=Not%20about%20Sudan/split=3/best" in sources.model_path(root, "Not about Sudan", 3)
    with pytest.raises(ValueError):
        sources.model_path(root, "RSF", kind="worst")


def test_network(data):
    models = train.train_labels(data, ["RSF"], estimator="mlp", hidden=16, max_iter=15)
    assert list(models["RSF"].getLayers()) == [64, 16, 8, 4, 2, 3]
    assert train.predict_labels(data, models).count() == 500


def test_oversampling_keeps_every_row(spark):
    df = spark.createDataFrame([("a", 0.0)] * 6 + [("b", 1.0)] * 2, "code string, label double")
    counts = {r["code"]: r["count"] for r in train.oversample(df, [(0, 2 / 3), (1, 2.0)]).groupBy("code").count().collect()}
    assert counts == {"a": 6, "b": 6}


def test_argument_checks(data):
    with pytest.raises(ValueError, match="estimator"):
        train.train_labels(data, ["RSF"], estimator="forest")
    with pytest.raises(ValueError, match="no annotated rows"):
        train.train_labels(data.withColumn("x", F.lit(None).cast("int")), ["x"])


def test_epochs(data, tmp_path):
    run = train.fit_epochs(data, data, "Sudanese", epochs=6, every=2, hidden=16)
    log = run.log.collect()
    assert {r["epoch"] for r in log} == {2, 4, 6} and len(log) == 3 * 2 * 4
    assert metrics.best_epoch(run.log).first()["epoch"] == run.best_epoch
    loss = {r["epoch"]: r["value"] for r in log if r["metric"] == "loss" and r["split"] == "train"}
    assert loss[6] <= loss[2]
    root = str(tmp_path / "models")
    sources.save_run(run, root, "Sudanese")
    for kind, model in (("best", run.best), ("latest", run.latest)):
        back = sources.load_model(root, "Sudanese", kind=kind)
        assert list(back.weights) == list(model.weights)


@pytest.mark.parametrize("epochs,every,steps", [(7, 3, [3, 6, 7]), (2, 5, [2]), (1, 1, [1])])
def test_every_requested_epoch_is_trained(data, epochs, every, steps):
    run = train.fit_epochs(data, data, "Sudanese", epochs=epochs, every=every, hidden=8)
    assert sorted({r["epoch"] for r in run.log.collect()}) == steps
    assert run.latest is not None and run.best is not None


def test_layer_shapes():
    assert train.mlp_layers(64, 128, 2, "shallow") == [64, 128, 2]
    assert train.mlp_layers(64, 16, 3) == [64, 16, 8, 4, 2, 3]
    for bad in ({"hidden": 4}, {"hidden": 8, "shape": "wide"}):
        with pytest.raises(ValueError):
            train.mlp_layers(64, n_classes=2, **bad)


def test_too_many_classes(data):
    with pytest.raises(ValueError, match="over 1 classes"):
        train.weights_by_label(data, ["RSF"], max_classes=1)


def test_train_epochs(data, tmp_path):
    runs, log, scores = train_epochs(
        data, ["RSF", "Sudanese"], model_root=str(tmp_path / "e"), epochs=4, every=3, shape="shallow", hidden=8
    )
    assert {(r["label"], r["epoch"]) for r in log.collect()} == {(n, e) for n in runs for e in (3, 4)}
    assert {(r["split"], r["label"]) for r in scores.collect()} == {
        (s, n) for s in ("train", "val", "test") for n in runs
    }
    for kind in ("best", "latest"):
        assert sources.load_model(str(tmp_path / "e"), "RSF", kind=kind) is not None


def test_train_and_test(data, tmp_path):
    models, scores = train_and_test(data, ["RSF"], model_root=str(tmp_path / "m"), max_iter=10)
    found = {r["split"]: r for r in scores.collect()}
    assert set(found) == {"train", "val", "test"}
    assert sum(r["n_rows"] for r in found.values()) == data.filter("RSF is not null").count()
    assert sources.load_model(str(tmp_path / "m"), "RSF").numClasses == 3


def test_cross_validation(data):
    out = cross_validate(data, "RSF", k=2, max_iter=10).collect()
    assert {(r["split"], r["metric"]) for r in out} == {
        (s, m) for s in ("Train", "Validation") for m in ("accuracy", "f1_weighted", "roc_auc")
    }
    assert all(r["n_splits"] == 2 for r in out)
    mean = {(r["split"], r["metric"]): r["mean"] for r in out}
    assert mean["Train", "accuracy"] > mean["Validation", "accuracy"]


def many_labels(spark, n=400, dim=6):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(dim)]
        rows.append((i, x, int(x[0] > 0), (x[1] > 0) + (x[2] > 0), None if i % 7 == 0 else int(x[3] > x[4])))
    return spark.createDataFrame(rows, "code long, embedding array<float>, two int, three int, some int")


def test_stacked_models_equal_single_ones(spark):
    data = many_labels(spark)
    models = train.train_labels(data, ["two", "three", "some"], max_iter=8)
    single = {(r["code"], r["label"]): r for r in train.predict_labels(data, models, keep=["two"]).collect()}
    stacked = train.predict_stacked(data, models, keep=["two"], block=64)
    assert stacked.columns == train.predict_labels(data, models, keep=["two"]).columns
    found = stacked.collect()
    assert len(found) == len(single) == 1200
    for r in found:
        other = single[r["code"], r["label"]]
        assert r["probs"] == pytest.approx(other["probs"], abs=1e-9)
        assert (r["prediction"], r["ground_truth"], r["two"]) == (other["prediction"], other["ground_truth"], other["two"])


def test_stacked_models_and_odd_vectors(spark):
    data = many_labels(spark)
    models = train.train_labels(data, ["two"], max_iter=2)
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 6)], "code long, embedding array<float>")
    found = {r["code"]: r for r in train.predict_stacked(odd, models).collect()}
    assert found[1]["probs"] is None and found[1]["prediction"] is None and len(found[2]["probs"]) == 2
    assert train.predict_stacked(odd.limit(0), models).collect() == []
    short = spark.createDataFrame([(1, [1.0])], "code long, embedding array<float>")
    with pytest.raises(Exception, match="length of the models"):
        train.predict_stacked(short, models).collect()


def test_labels_fitted_at_the_same_time(spark):
    data = many_labels(spark)
    one, four = (train.train_labels(data, ["two", "three", "some"], max_iter=5, parallel=n) for n in (1, 4))
    assert list(one) == list(four)
    for name in one:
        assert one[name].coefficientMatrix.toArray() == pytest.approx(four[name].coefficientMatrix.toArray())
    with pytest.raises(ValueError, match="no annotated rows"):
        train.train_labels(data.withColumn("two", F.lit(None).cast("int")), ["two", "three"])
