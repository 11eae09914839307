import pytest
from pyspark.sql import functions as F

from stancewright.operators import report


@pytest.fixture
def posts(spark):
    return spark.createDataFrame(
        [
            ("a", "2023-01-05", 1, 0, 0), ("b", "2023-01-09", 1, 1, 0),
            ("c", "2024-01-01", 0, 1, 0), ("d", "2023-03-01 12:00:00", 1, None, 0),
        ],
        "code string, date string, x int, y int, z int",
    )


def test_prevalence(posts):
    got = [tuple(r) for r in report.label_prevalence(posts, ["z", "y", "x"]).collect()]
    assert got == [("x", 3, 0.6, "60.00%"), ("y", 2, 0.4, "40.00%"), ("z", 0, 0.0, "0.00%")]


def test_prevalence_of_one_month_and_some_labels(posts):
    got = report.label_prevalence(posts, ["x", "y", "z"], "date", 1, ["y", "z"]).collect()
    assert [(r["label"], r["positives"], r["share"]) for r in got] == [("y", 2, 0.5), ("z", 0, 0.0)]
    with pytest.raises(ValueError):
        report.label_prevalence(posts, ["x"], month=1)


def test_share_of_nothing_is_null(posts):
    assert report.label_prevalence(posts, ["z"]).first()["share"] is None
    assert report.label_prevalence(posts, ["z"]).first()["percentage"] is None


def test_monthly_share(posts, rows):
    got = rows(report.monthly_share(posts, ["x", "y", "z"]), "label", "month", "positives", "share")
    assert got == [
        ("x", 1, 2, pytest.approx(2 / 3)), ("x", 3, 1, pytest.approx(1 / 3)),
        ("y", 1, 2, 1.0), ("y", 3, 0, 0.0),
        ("z", 1, 0, None), ("z", 3, 0, None),
    ]


def test_year_months_stay_apart(posts):
    months = report.monthly_counts(posts, ["x"], calendar="year-month")
    assert months.select("month").distinct().count() == 3


def test_months_in_order_with_total(posts):
    got = [tuple(r) for r in report.months_with_total(posts).collect()]
    assert got == [("1", 3), ("3", 1), ("All", 4)]


def test_unreadable_dates_are_shown(spark, rows):
    texts = ["nope", "2023-02-01", "15 Apr 2023", "04/16/2023", None]
    df = spark.createDataFrame([(t, 1) for t in texts], "date string, x int")
    assert [tuple(r) for r in report.months_with_total(df).collect()] == [
        ("2", 1), ("4", 2), ("unreadable", 2), ("All", 5),
    ]
    assert rows(report.monthly_counts(df, ["x"])) == [(2, "x", 1), (4, "x", 2), (None, "x", 2)]
    shares = report.monthly_share(df, ["x"]).agg(F.sum("share"), F.sum("positives")).first()
    assert tuple(shares) == (1.0, 5)


def test_preview(posts):
    assert [r["code"] for r in report.preview(posts, n=2).collect()] == ["a", "b"]


def test_score_summary(spark, rows):
    cells = spark.createDataFrame(
        [("RSF", "0.61±0.11", "0.52±0.12", "0.43±0.13", "n/a")],
        "Label string, `Train F1` string, `Validation F1` string, `Train ROC AUC` string, "
        "`Validation ROC AUC` string",
    )
    assert rows(report.score_summary(cells)) == [
        ("RSF", "Train", "F1", 0.61, 0.11), ("RSF", "Train", "ROC AUC", 0.43, 0.13),
        ("RSF", "Validation", "F1", 0.52, 0.12), ("RSF", "Validation", "ROC AUC", None, None),
    ]


def test_stack(spark, rows):
    a = spark.createDataFrame([("l", 1.0)], "label string, v double")
    assert rows(report.stack_scores(a, a)) == [("l", 1.0, "Train"), ("l", 1.0, "Validation")]


def test_shares_sum_to_one(posts):
    total = report.monthly_share(posts, ["x", "y"]).groupBy("label").agg(F.sum("share").alias("s"))
    assert {round(r["s"], 9) for r in total.collect()} == {1.0}


def test_day_first_columns(spark, rows):
    posts = spark.createDataFrame([("15/04/2023", 1), ("04/05/2023", 1), ("no day", 1)], "date string, x int")
    assert rows(report.monthly_counts(posts, ["x"]), "month", "positives") == [(4, 1), (5, 1), (None, 1)]
    assert rows(report.label_prevalence(posts, ["x"], "date", month=5), "positives") == [(1,)]
    american = ["M/d/yyyy"]
    assert rows(report.label_prevalence(posts, ["x"], "date", month=4, formats=american), "positives") == [(1,)]
    assert rows(report.monthly_counts(posts, ["x"], formats=american), "month", "positives") == [(4, 1), (None, 2)]
