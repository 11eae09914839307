import pytest
from pyspark.sql import functions as F

from stancewright import schemas
from stancewright.operators import clean

NAN = float("nan")


def sheet(spark, overrides):
    """Rows of the labelled sheet: all labels 0 unless overridden."""
    data = []
    for i, extra in enumerate(overrides):
        row = {"permalink": f"https://h/u/status/{i}", "post": f"p{i}", "user": "u", "username": "n"}
        row |= {label: 0.0 for label in schemas.BINARY_LABELS}
        data.append(row | extra)
    columns = ["permalink", "post", "user", "username", *schemas.BINARY_LABELS]
    types = ", ".join(f"`{c}` {'string' if i < 4 else 'double'}" for i, c in enumerate(columns))
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in data], types)


def test_missing_values(spark):
    df = sheet(spark, [{"anti war": NAN}, {"Likely bot": None}, {"user": None}, {"Likely bot": NAN}])
    out = {r["code"]: r for r in clean.clean_labelled(df).collect()}
    assert sorted(out) == ["1", "2", "3"]
    assert out["1"]["Likely bot"] == 0 and out["3"]["Likely bot"] == 0
    assert out["2"]["user"] == "unknown" and out["1"]["user"] == "u"


def test_filters(spark):
    df = sheet(
        spark,
        [{}, {"Not about Sudan": 1.0}, {"Not about Sudan": NAN}, {"Not Sudanese": 1.0}],
    )

    def codes(**switches):
        return sorted(r["code"] for r in clean.clean_labelled(df, **switches).collect())

    assert codes() == ["0", "1", "2", "3"]
    assert codes(on_topic_only=True) == ["0", "2", "3"]
    assert codes(in_group_only=True) == ["0", "1", "2"]
    # Unfilled, a missing flag does not pass the filter.
    assert codes(drop_missing=False, on_topic_only=True) == ["0", "3"]


def test_corrections(spark):
    df = sheet(spark, [{"pro RSF": 1.0}, {"pro RSF": 1.0, "Likely bot": NAN}])
    fixes = spark.createDataFrame(
        [("0", "pro RSF", 0), ("1", "Likely bot", 1), ("9", "pro RSF", 1)], schemas.CORRECTIONS
    )
    out = {r["code"]: r for r in clean.clean_labelled(df, corrections=fixes).collect()}
    assert len(out) == 2
    assert out["0"]["pro RSF"] == 0 and out["1"]["pro RSF"] == 1
    assert out["1"]["Likely bot"] == 1
    unmatched = clean.unmatched_corrections(clean.extract_code(df), fixes)
    assert [r["code"] for r in unmatched.collect()] == ["9"]


def test_correction_checks(spark):
    fixes = spark.createDataFrame(
        [("0", "a", 0), ("0", "a", 1), ("0", "b", 1), ("0", "zzz", 1)], schemas.CORRECTIONS
    )
    assert [tuple(r) for r in clean.duplicate_corrections(fixes).collect()] == [("0", "a", 2)]
    df = spark.createDataFrame([("0", 1, 1)], "code string, a int, b int")
    assert [r["column"] for r in clean.unmatched_corrections(df, fixes).collect()] == ["zzz"]


def test_contradictory_corrections_fail(spark, rows):
    df = spark.createDataFrame([("0", 1, 1), ("1", 1, 0)], "code string, a int, b int")
    one = [("0", "a", 0), ("0", "a", 0), ("1", "b", None), ("1", "a", None)]
    kind = "code string, column string, value int"
    fixes = spark.createDataFrame(one, kind)
    assert rows(clean.apply_corrections(df, fixes, ["a", "b"])) == [("0", 0, 1), ("1", None, None)]
    for second in (1, None):
        wrong = spark.createDataFrame([*one, ("0", "a", second)], kind)
        with pytest.raises(Exception, match="contradictory corrections of a"):
            clean.apply_corrections(df, wrong, ["a", "b"]).collect()


def test_canonical_labels(spark):
    df = spark.createDataFrame([(1, 0)], "`Pro peace,` int, `Pro War` int")
    assert clean.canonical_labels(df).columns == ["pro peace", "pro war"]


def test_fill_leaves_other_text_alone(spark):
    df = spark.createDataFrame([(None, None, None)], "user string, note string, n int")
    assert tuple(clean.fill_missing(df, ["user", "username"]).first()) == ("unknown", None, 0)


def test_drop_incomplete(spark, rows):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, NAN)], "k int, v double")
    assert rows(clean.drop_incomplete(df)) == [(1, 1.0)]
    assert len(rows(clean.drop_incomplete(df, ["k"]))) == 3


def test_training_view(spark):
    df = spark.createDataFrame([("c", "p", 1, 0)], "code string, post string, a int, b int")
    assert clean.training_view(df, ["b"]).columns == ["code", "post", "b"]
    assert clean.training_view(df).columns == ["code", "post", "a", "b"]


def test_audit(spark, rows):
    df = spark.createDataFrame([("0", 1), ("1", None), ("2", 0)], "code string, a int")
    audit = clean.cleaning_audit(df, df.na.drop(), ["a"])
    assert rows(audit, "stage", "n_rows", "label", "positives") == [
        ("after", 2, "a", 1), ("before", 3, "a", 1),
    ]


@pytest.mark.parametrize("hot", [2000])
def test_corrections_with_a_hot_code(spark, hot):
    df = spark.range(hot).select(F.lit("same").alias("code"), F.lit(1).alias("a"))
    fixes = spark.createDataFrame([("same", "a", 0)], schemas.CORRECTIONS)
    out = clean.apply_corrections(df, fixes, ["a"])
    assert out.count() == hot and out.agg(F.sum("a")).first()[0] == 0
