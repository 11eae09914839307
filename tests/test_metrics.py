import itertools
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stancewright.operators import metrics

LONG = "label string, ground_truth int, prediction int"
SCORED = "label string, ground_truth int, score double"


def brute_auc(pairs):
    """Share of (positive, negative) pairs in the right order."""
    pos = [s for t, s in pairs if t == 1]
    neg = [s for t, s in pairs if t != 1]
    if not pos or not neg:
        return None
    won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    return won / (len(pos) * len(neg))


def test_confusion_and_scores(spark):
    data = [("a", 1, 1)] * 3 + [("a", 1, 0)] * 2 + [("a", 0, 1)] + [("a", 0, 0)] * 4 + [("a", None, 1)]
    row = metrics.binary_scores(metrics.confusion(spark.createDataFrame(data, LONG))).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (4, 1, 2, 3)
    assert row["accuracy"] == 0.7 and row["precision"] == 0.75 and row["recall"] == 0.6
    assert row["f1"] == pytest.approx(2 * 0.75 * 0.6 / 1.35)
    assert row["roc_auc_hard"] == pytest.approx((3 / 5 + 4 / 5) / 2)


@pytest.mark.parametrize("undefined, value", [("zero", 0.0), ("null", None)])
def test_no_predicted_positive(spark, undefined, value):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 0)], LONG)
    row = metrics.binary_scores(metrics.confusion(df), undefined).first()
    assert row["precision"] == value and row["f1"] == value and row["recall"] == 0.0
    with pytest.raises(ValueError):
        metrics.binary_scores(metrics.confusion(df), "nan")


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 1)], LONG)
    assert metrics.binary_scores(metrics.confusion(df)).first()["roc_auc_hard"] is None
    scored = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.4)], SCORED)
    assert metrics.roc_auc(scored).first()["roc_auc"] is None


def test_wide_counts_equal_long_counts(spark, rows):
    rng = random.Random(3)
    data = [tuple(rng.choice([0, 1, None]) for _ in range(4)) for _ in range(200)]
    wide = spark.createDataFrame(data, "a int, b int, pa int, pb int")
    long = wide.select("a", "pa").withColumn("label", F.lit("a")).union(
        wide.select("b", "pb").withColumn("label", F.lit("b"))
    )
    assert rows(metrics.confusion_wide(wide, {"a": ("a", "pa"), "b": ("b", "pb")})) == rows(
        metrics.confusion(long, ["label"], "a", "pa")
    )


def test_weighted_f1(spark):
    data = [("a", t, p) for t, p in [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 3)]]
    row = metrics.weighted_f1(spark.createDataFrame(data, LONG)).first()
    # Per class: 0 -> 1/2, 1 -> 4/5, 2 -> 0; class 3 is never true and weighs nothing.
    assert row["f1_weighted"] == pytest.approx((2 * 0.5 + 2 * 0.8) / 6)
    assert row["accuracy"] == 0.5 and row["n_rows"] == 6 and row["n_classes"] == 3


def test_auc_ties_count_half(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5)], SCORED)
    assert metrics.roc_auc(df).first()["roc_auc"] == 0.5


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.integers(0, 1), st.sampled_from([-1.5, 0.0, 0.25, 0.5, 7.0])),
        min_size=1, max_size=40,
    )
)
def test_auc_equals_brute_force(spark, data):
    got = {r["label"]: r["roc_auc"] for r in metrics.roc_auc(spark.createDataFrame(data, SCORED)).collect()}
    for label in {d[0] for d in data}:
        expected = brute_auc([d[1:] for d in data if d[0] == label])
        assert got[label] == (None if expected is None else pytest.approx(expected))


def test_auc_with_many_scores_and_one_hot_score(spark):
    """A third of the rows share a score; the rest spread over several slices."""
    rng = random.Random(5)
    data = [("a", rng.randint(0, 1), 0.5 if i % 3 == 0 else rng.random()) for i in range(1500)]
    df = spark.createDataFrame(data, SCORED).repartition(4)
    coalescing = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = metrics.roc_auc(df).first()["roc_auc"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalescing)
    assert got == pytest.approx(brute_auc([d[1:] for d in data]))
    mirrored = metrics.roc_auc(df.withColumn("score", -F.col("score"))).first()["roc_auc"]
    assert got + mirrored == pytest.approx(1.0)


def test_auc_macro_skips_undefined(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.1), ("b", 1, 0.5)], SCORED)
    assert tuple(metrics.roc_auc_macro(metrics.roc_auc(df)).first()) == (1.0, 1)


def brute_ovo(data, k):
    areas = []
    for a, b in itertools.permutations(range(k), 2):
        area = brute_auc([(int(t == a), p[a]) for t, p in data if t in (a, b)])
        if area is not None:
            areas.append(area)
    return sum(areas) / len(areas) if areas else None


@pytest.mark.parametrize("classes", [[0, 1, 2], [0, 2], [0, 1]])
def test_ovo_equals_brute_force(spark, classes):
    rng = random.Random(len(classes))
    data = []
    for _ in range(60):
        p = [rng.choice([0.1, 0.3, 0.6]) for _ in range(3)]
        data.append((rng.choice(classes), p))
    df = spark.createDataFrame([("a", t, p) for t, p in data], "label string, ground_truth int, probs array<double>")
    row = metrics.roc_auc_ovo(df).first()
    assert row["roc_auc_ovo"] == pytest.approx(brute_ovo(data, 3))
    assert row["n_pairs"] == len(classes) * (len(classes) - 1)


def test_log_loss(spark):
    df = spark.createDataFrame(
        [("a", 0, [0.5, 0.5], 1.0), ("a", 1, [0.75, 0.25], 3.0), ("a", 1, [1.0, 0.0], 0.0)],
        "label string, ground_truth int, probs array<double>, w double",
    )
    expected = (math.log(2) + 3 * math.log(4)) / 4
    assert metrics.log_loss(df, weight="w").first()["log_loss"] == pytest.approx(expected)
    assert metrics.log_loss(df).first()["log_loss"] == pytest.approx(
        (math.log(2) + math.log(4) - math.log(1e-15)) / 3
    )
    unknown = df.withColumn("ground_truth", F.lit(5))
    with pytest.raises(Exception):
        metrics.log_loss(unknown).collect()


PREDS = "label string, ground_truth int, prediction int, probs array<double>"


def test_evaluate_picks_the_area_by_class_count(spark):
    data = [("bin", t, int(p > 0.5), [1 - p, p]) for t, p in [(1, 0.9), (0, 0.6), (0, 0.2), (1, 0.4)]]
    data += [("tri", t, p.index(max(p)), p) for t, p in [(0, [0.6, 0.3, 0.1]), (1, [0.2, 0.5, 0.3]), (2, [0.5, 0.3, 0.2])]]
    data += [("one", 0, 0, [1.0, 0.0])]
    got = {r["label"]: r for r in metrics.evaluate(spark.createDataFrame(data, PREDS)).collect()}
    assert got["bin"]["roc_auc"] == 0.5 and got["bin"]["roc_auc_scores"] == 0.75
    tri = [(t, p) for label, t, _, p in data if label == "tri"]
    assert got["tri"]["roc_auc"] == pytest.approx(brute_ovo(tri, 3))
    assert got["one"]["roc_auc"] is None and got["one"]["accuracy"] == 1.0


def test_hard_auc_is_the_mean_recall_and_works_for_other_classes(spark):
    data = [("a", 2, 2), ("a", 2, 0), ("a", 0, 0), ("a", 0, 1)]
    counts = metrics.class_confusion(spark.createDataFrame(data, LONG))
    pairs = [(int(t == 2), p) for _, t, p in data]
    assert metrics.hard_auc(counts).first()["roc_auc_hard"] == pytest.approx(brute_auc(pairs))


def test_best_epoch(spark, rows):
    nan = float("nan")
    log = [
        ("a", 5, 0.5), ("a", 10, 0.9), ("a", 15, 0.9), ("a", 20, nan), ("a", 25, None),
        ("b", 5, 0.0),
    ]
    df = spark.createDataFrame(
        [(n, e, "val", "accuracy", v) for n, e, v in log] + [("a", 1, "train", "accuracy", 1.0)],
        "label string, epoch int, split string, metric string, value double",
    )
    assert rows(metrics.best_epoch(df)) == [("a", 10, 0.9), ("b", 5, 0.0)]


def test_summarise_splits(spark):
    df = spark.createDataFrame([("a", "f1", 0.5), ("a", "f1", 0.7)], "label string, metric string, value double")
    assert metrics.summarise_splits(df).first()["spread"] == pytest.approx(0.1)
    assert metrics.summarise_splits(df, spread="sample").first()["spread"] == pytest.approx(0.02**0.5)
    with pytest.raises(ValueError):
        metrics.summarise_splits(df, spread="iqr")
