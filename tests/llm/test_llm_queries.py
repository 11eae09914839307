"""Registered queries against their SQL, and the shape that the contracts fix."""

import math

import duckdb
import pytest

from stancewright.llm.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
CONTRACT = {
    "op4_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op5_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op7_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op11_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, "
    "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


def keeps_contract(name, df):
    kinds = dict(df.dtypes)
    for column in filter(None, CONTRACT.get(name, "").split(", ")):
        key, kind = column.split()
        assert kinds[key] == kind


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    keeps_contract(name, df)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == expected
    assert expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    keeps_contract(name, df)
    assert df.count() >= 50


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
