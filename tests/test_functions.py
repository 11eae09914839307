import datetime
import math

import pytest
from pyspark.sql import functions as F

from stancewright import functions as fn


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "link, code",
    [("https://h/u/status/123", "123"), ("https://h/u/status/123/", ""), ("abc", "abc")],
)
def test_last_segment(spark, link, code):
    assert one(spark, fn.last_segment(F.lit(link))) == code


@pytest.mark.parametrize("n, code", [(0, "TW000"), (7, "TW007"), (1000, "TW1000")])
def test_sequence_code(spark, n, code):
    assert one(spark, fn.sequence_code(F.lit(n))) == code


@pytest.mark.parametrize(
    "cell, mean, spread",
    [("1.0±0.0", 1.0, 0.0), ("0.9±0.2", 0.9, 0.2), ("n/a", None, None), ("0.5", 0.5, None)],
)
def test_score_cell(spark, cell, mean, spread):
    assert one(spark, fn.score_mean(F.lit(cell))) == mean
    assert one(spark, fn.score_spread(F.lit(cell))) == spread


@pytest.mark.parametrize(
    "share, text", [(0.5, "50.00%"), (0.00125, "0.12%"), (1.0, "100.00%"), (None, None)]
)
def test_percent_text(spark, share, text):
    assert one(spark, fn.percent_text(F.lit(share).cast("double"))) == text


@pytest.mark.parametrize(
    "score, hit", [(0.5, 0), (0.50001, 1), (0.0, 0), (float("nan"), 0), (None, None)]
)
def test_threshold_is_strict(spark, score, hit):
    assert one(spark, fn.threshold(F.lit(score).cast("double"))) == hit


def test_softmax_is_stable_and_sums_to_one(spark):
    probs = one(spark, fn.softmax(F.array(F.lit(1000.0), F.lit(1001.0), F.lit(0.0))))
    e = math.exp(-1)
    assert probs == pytest.approx([e / (1 + e), 1 / (1 + e), 0.0])


def test_sigmoid(spark):
    assert one(spark, fn.sigmoid(F.lit(0.0))) == 0.5
    assert one(spark, fn.sigmoid(F.lit(-800.0))) == 0.0


@pytest.mark.parametrize("values, at", [([0.2, 0.5, 0.3], 1), ([0.4, 0.4, 0.2], 0), ([1.0], 0)])
def test_argmax_takes_the_first_of_equals(spark, values, at):
    array = F.array(*[F.lit(v) for v in values])
    assert one(spark, fn.argmax(array)) == at
    assert one(spark, fn.top_probability(array)) == max(values)


def test_dates(spark):
    assert one(spark, fn.parse_date(F.lit("2023-04-15 10:00:00"))).month == 4
    assert one(spark, fn.parse_date(F.lit("no date"))) is None
    for text in ("15 Apr 2023", "4/15/2023", "15.4.2023", "April 15, 2023", "Sat Apr 15 08:30:00 +0000 2023"):
        found = one(spark, fn.parse_date(F.lit(text)))
        assert (found.month, found.day) == (4, 15)
    assert one(spark, fn.parse_date(F.lit("2023|15|04"), ["yyyy|dd|MM"])).month == 4
    with pytest.raises(Exception, match="unreadable date: no date"):
        one(spark, fn.parse_date(F.lit("no date"), unreadable="fail"))
    assert one(spark, fn.parse_date(F.lit(None).cast("string"), unreadable="fail")) is None
    day = F.lit("2023-04-15").cast("date")
    assert one(spark, fn.month_of(day)) == 4
    assert one(spark, fn.month_of(day, "year-month")) == datetime.date(2023, 4, 1)
    with pytest.raises(ValueError):
        fn.month_of(day, "week")


def test_names(spark):
    assert one(spark, fn.stance_name("pro", F.lit("war"))) == "pro war"
    assert one(spark, fn.polarity_text(F.lit(1))) == "Positive"
    assert one(spark, fn.polarity_text(F.lit(2))) == "Negative"


def test_nan_to_null(spark):
    assert one(spark, fn.nan_to_null(F.lit(float("nan")))) is None
    assert one(spark, fn.nan_to_null(F.lit(2.5))) == 2.5


def test_one_form_of_dates_per_column(spark):
    frame = lambda *texts: spark.createDataFrame([(t,) for t in texts], "date string")

    def months(df):
        formats = fn.formats_of(fn.day_first(df, "date"))
        return [r[0] for r in df.select(F.month(fn.parse_date(F.col("date"), formats))).collect()]

    assert months(frame("15/04/2023", "04/05/2023", None)) == [4, 5, None]
    assert months(frame("04/15/2023", "04/05/2023 10:30")) == [4, 4]
    assert months(frame("04/05/2023")) == [4]
    assert months(frame("15-04-2023", "04-05-2023", "20230615", "2023-07-01")) == [4, 5, 6, 7]
    assert months(frame()) == []
    both = frame("15/04/2023", "04/15/2023")
    with pytest.raises(ValueError, match="day first in '15/04/2023' and the month in '04/15/2023'"):
        fn.day_first(both, "date")
    assert fn.day_first(both, "date", mixed="month") is False
    with pytest.raises(ValueError):
        fn.day_first(both, "date", mixed="day")


def test_softmax_takes_time_in_proportion(spark):
    import time

    def seconds(dim, n=400):
        z = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sin(i * F.col("id")))
        probs = spark.range(n).select(fn.softmax(z).alias("p"))
        found = probs.select(F.max(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1)))
        start = time.time()
        assert found.first()[0] < 1e-9
        return time.time() - start

    seconds(8)
    # Quadratic work would be over two thousand times that of 64 dimensions.
    assert seconds(3072) < 48 * seconds(64) + 10
