"""Every registered query against its SQL equivalent in DuckDB."""

import math

import duckdb
import pytest

from conftest import SF
from stancewright.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SPARK_TYPES = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "float",
    "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert dict(df.dtypes) == {c[0]: SPARK_TYPES[str(c[1])] for c in found.description}
    expected = sorted(tuple(map(comparable, r)) for r in found.fetchall())
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    assert sorted(tuple(map(comparable, r)) for r in rows) == expected
    assert expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_stream_of_a_table_in_several_files(spark, tmp_path, rows):
    """A large table is a folder of files, which a stream has to find like a table of one file."""
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, None, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int"
    )
    labels.repartition(3).write.parquet(str(tmp_path / "labels.parquet"))
    # Beside the table, as other tables are.
    labels.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["stream_stance"](spark, str(tmp_path))
    expected = [(1, 1, 0, 1), (2, 0, 1, 0), (3, 1, 1, 2), (4, None, 0, 2), (4, None, 0, 2)]
    assert rows(found, "doc_id", "quality", "toxic", "topic") == sorted(expected, key=repr)
