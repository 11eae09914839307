"""The splittable reader of multi-line CSV gives the rows of Spark's own."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stancewright import sources

CELLS = st.text(alphabet='ab ,"\n\r\\é汉', max_size=12)


@pytest.fixture
def small_slices(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(value):
    quoted = any(c in value for c in ',"\n\r') or value != value.strip() or not value
    return '"' + value.replace('"', '""') + '"' if quoted else value


def as_csv(table):
    return "a,b,c\n" + "".join(",".join(map(cell, row)) + "\n" for row in table)


def both(spark, path, rows):
    return rows(sources.read_csv_text(spark, path, "split")), rows(sources.read_csv_text(spark, path, True))


def test_many_tasks_and_equal_rows(spark, small_slices, tmp_path, rows):
    rng = random.Random(3)
    part = lambda: "".join(rng.choice('xy ,"\n') for _ in range(rng.randrange(0, 30)))
    table = [(f"l{i}", part(), "" if i % 7 == 0 else part()) for i in range(200)]
    table += [("long", "one\ncell\nover\nmany\nslices " * 60, "end")]
    for name, chunk in (("one.csv", table), ("two.csv", table[:3]), ("three.csv", [])):
        (tmp_path / name).write_text(as_csv(chunk), encoding="utf-8", newline="")
    split = sources.read_csv_text(spark, str(tmp_path), "split")
    assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 50
    found, expected = both(spark, str(tmp_path), rows)
    assert found == expected and len(found) == 204
    assert split.columns == ["a", "b", "c"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.just("k"), CELLS, CELLS), min_size=1, max_size=12))
def test_any_cells(spark, small_slices, tmp_path, rows, table):
    path = tmp_path / "any.csv"
    path.write_text(as_csv(table), encoding="utf-8", newline="")
    found, expected = both(spark, str(path), rows)
    assert found == expected


def test_line_ends_and_empty_lines(spark, small_slices, tmp_path, rows):
    path = tmp_path / "crlf.csv"
    path.write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    assert rows(sources.read_csv_text(spark, str(path), "split")) == [("1", "x\r\ny"), ("2", "z")]


def test_file_without_last_line_end(spark, small_slices, tmp_path, rows):
    path = tmp_path / "open.csv"
    path.write_text('a,b\n1,"x\ny"', newline="")
    assert rows(sources.read_csv_text(spark, str(path), "split")) == [("1", "x\ny")]


def test_unclosed_quote_is_an_error(spark, small_slices, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text('a,b\n1,"x\n' + "2,y\n" * 50)
    with pytest.raises(Exception, match="ends inside a quoted cell"):
        sources.read_csv_text(spark, str(path), "split").collect()


def test_only_header(spark, tmp_path, rows):
    path = tmp_path / "none.csv"
    path.write_text("a,b\n")
    df = sources.read_csv_text(spark, str(path), "split")
    assert rows(df) == [] and df.columns == ["a", "b"]
