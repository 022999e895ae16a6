"""Every query with SQL gives DuckDB's rows; the others run."""

import os

import duckdb
import pytest

import __spark_entry__
from pitchline import model_queries, queries

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries.queries()[name](spark, sf_dir)
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert got == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - set(model_queries.queries())))
def test_query_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_names_do_not_clash():
    assert not set(queries._QUERIES) & set(model_queries.queries())


def test_workers_find_the_package(spark, sf_dir):
    __spark_entry__.queries()["label_1x2"](spark, sf_dir)
    assert __spark_entry__.ROOT in spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep)
