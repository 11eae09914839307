import itertools

import pytest

from stancewright.operators import labels


def test_fold_all_nine_pairs(spark):
    pairs = list(itertools.product([0, 1, None], repeat=2))
    df = spark.createDataFrame(pairs, "pro int, anti int")
    got = {(r["pro"], r["anti"]): r["s"] for r in labels.merge_stance(df, "pro", "anti", "s").collect()}
    assert got == {p: {(1, 0): 1, (0, 1): 0}.get(p, 2) for p in pairs}


def test_fold_default_topics(spark):
    from stancewright import schemas

    names = [n for pair in schemas.TOPIC_PAIRS.values() for n in pair]
    df = spark.createDataFrame([tuple([1, 0] * 5)], ", ".join(f"`{n}` int" for n in names))
    row = labels.merge_topics(df).first()
    assert [row[t] for t in schemas.TOPIC_PAIRS] == [1] * 5


def test_conflicts(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 1), ("b", 1, None), ("c", None, None), ("d", 2, 0), ("e", 0, 0), ("f", 1, 0)],
        "code string, p int, a int",
    )
    found = labels.stance_conflicts(df, {"t": ("p", "a")})
    assert rows(found, "code", "topic", "reason") == [
        ("a", "t", "both"), ("b", "t", "missing"), ("c", "t", "missing"), ("d", "t", "other"),
    ]


PRED = "code string, label string, ground_truth int, prediction int, prob double, probs array<double>"


def unmerged(spark, truth, pred, prob, label="RSF", **options):
    df = spark.createDataFrame([("x", label, truth, pred, prob, [0.1, 0.7, 0.2])], PRED)
    out = labels.unmerge_stance(df, ["RSF"], **options)
    return {
        r["key"]: (r["ground_truth"], r["prediction"], pytest.approx(r["prob"]), r["is_correct"])
        for r in out.collect()
    }


def test_unfold_three_states(spark):
    assert unmerged(spark, 1, 1, 0.8) == {
        "pro RSF": (1, 1, 0.8, True), "anti RSF": (0, 0, 0.2, True),
    }
    assert unmerged(spark, 1, 0, 0.8) == {
        "pro RSF": (1, 0, 0.2, False), "anti RSF": (0, 1, 0.8, False),
    }
    assert unmerged(spark, 0, 2, 0.8) == {
        "pro RSF": (0, 0, 0.0, True), "anti RSF": (1, 0, 0.0, False),
    }


def test_unfold_binary_and_missing_truth(spark):
    assert unmerged(spark, 0, 1, 0.6, "Sudanese") == {"Sudanese": (0, 1, 0.6, False)}
    assert unmerged(spark, None, 1, 0.8)["pro RSF"] == (1, 1, 0.8, True)


def test_unfold_with_full_probabilities(spark):
    got = unmerged(spark, 1, 1, 0.7, full_probs=True)
    assert got["pro RSF"][2] == 0.7 and got["anti RSF"][2] == 0.1


@pytest.mark.parametrize("pro, anti", [(1, 0), (0, 1), (0, 0)])
def test_unfold_inverts_fold(spark, pro, anti):
    state = {(1, 0): 1, (0, 1): 0, (0, 0): 2}[pro, anti]
    got = unmerged(spark, state, state, 1.0)
    assert (got["pro RSF"][1], got["anti RSF"][1]) == (pro, anti)


def test_merged_view(spark, rows):
    df = spark.createDataFrame([("x", "RSF", None, 2, 0.5, []), ("x", "war", 1, 0, 0.9, [])], PRED)
    assert rows(labels.merged_view(df), "key", "ground_truth", "prediction", "is_correct") == [
        ("RSF", 2, 2, True), ("war", 1, 0, False),
    ]
