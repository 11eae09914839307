import pytest
from pyspark.sql import functions as F

from stancewright import schemas, sources


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_labelled_csv(spark, tmp_path):
    path = write(
        tmp_path / "l.csv",
        'Pro War,permalink,post,"Pro peace,",extra\n'
        '1.0,https://h/1,"two\nlines, ""quoted""",,x\n'
        "NaN,https://h/2,سلام,0,y\n",
    )
    df = sources.read_labelled(spark, path)
    a, b = df.orderBy("permalink").collect()
    assert a["post"] == 'two\nlines, "quoted"' and a["pro war"] == 1 and a["pro peace"] is None
    assert b["post"] == "سلام" and b["pro war"] is None and b["pro peace"] == 0
    assert a["user"] is None and a["extra"] == "x"
    assert df.schema["pro war"].dataType.simpleString() == "int"


def test_broken_label_is_an_error(spark, tmp_path):
    path = write(tmp_path / "l.csv", "permalink,Pro War\nhttps://h/1,0.5\n")
    with pytest.raises(Exception, match="holds no whole number"):
        sources.read_labelled(spark, path).collect()


def test_files_with_other_headers_are_not_mixed_up(spark, tmp_path):
    folder = tmp_path / "posts"
    folder.mkdir()
    write(folder / "a.csv", "permalink,post\nl1,p1\n")
    write(folder / "b.csv", "post,permalink\np2,l2\n")
    with pytest.raises(Exception):
        sources.read_posts(spark, str(folder)).collect()


def test_csv_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame(
        [("l/1", 'a "b", c\n\\ d', [1.0, 2.0]), ("l/2", "", None), ("l/3", None, []), ("l/4", "  x ", [])],
        "permalink string, post string, v array<double>",
    )
    path = str(tmp_path / "out")
    sources.export_csv(df, path)
    back = sources.read_posts(spark, path)
    expected = [(k, text or None) for k, text in rows(df, "permalink", "post")]
    assert rows(back, "permalink", "post") == expected
    assert ("[1.0,2.0]",) in rows(back, "v")


def test_parquet_and_unknown_formats(spark, tmp_path, rows):
    df = spark.createDataFrame([("l/1", float("nan"))], "permalink string, `Pro War` double")
    df.write.parquet(str(tmp_path / "p"))
    assert rows(sources.read_labelled(spark, str(tmp_path / "p"), "parquet"), "permalink", "pro war") == [("l/1", None)]
    with pytest.raises(ValueError):
        sources.read_posts(spark, "x", "xlsx")


def test_classified(spark, tmp_path):
    for name, n in (("all", 3), ("relevant", 1)):
        spark.range(n).write.parquet(str(tmp_path / name))
    a, r = str(tmp_path / "all"), str(tmp_path / "relevant")
    assert sources.read_classified(spark, a).count() == 3
    assert sources.read_classified(spark, a, r, relevant_only=True).count() == 1
    with pytest.raises(ValueError):
        sources.read_classified(spark, a, relevant_only=True)


def test_embedding_store(spark, tmp_path):
    old = spark.createDataFrame([("a", [1.0])], "code string, large_embs array<double>")
    path = str(tmp_path / "store")
    sources.write_embeddings(old, path)
    df = sources.read_embeddings(spark, path, vector="large_embs")
    assert df.dtypes == [("code", "string"), ("embedding", "array<float>")]
    with pytest.raises(Exception, match="already exists"):
        sources.write_embeddings(old, path)


def test_scores(spark, tmp_path):
    path = write(tmp_path / "s.csv", "Label,Train F1,Validation F1\nRSF,0.61±0.11,0.52±0.12\n")
    row = sources.read_scores(spark, path).first()
    assert row["Train F1"] == "0.61±0.11" and row["Train Accuracy"] is None


def test_posts_by_month(spark, tmp_path):
    df = spark.range(6).withColumn("month", F.col("id") % 2)
    path = str(tmp_path / "posts")
    sources.write_posts(df, path, by="month")
    back = spark.read.parquet(path).filter("month = 1")
    assert back.count() == 3
    assert "PartitionFilters: [isnotnull(month" in back._jdf.queryExecution().toString()


def test_label_sets():
    assert len(schemas.BINARY_LABELS) == 17 and len(schemas.REPORT_LABELS) == 16
    assert len(schemas.REQUIRED_LABELS) == 12 and len(schemas.DEMO_LABELS) == 13
    assert set(schemas.REQUIRED_LABELS) < set(schemas.BINARY_LABELS)
