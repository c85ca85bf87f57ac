"""Every query of the catalogue against its SQL, and the contract of __spark_entry__."""

import duckdb
import pytest

import __spark_entry__ as entry
from storyloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


NULL = "\0null"


def plain(columns, rows):
    """Sorted rows as text, columns by name; taken from the engines' own rows, as pandas turns whole numbers beside
    nulls into floats on one side only."""

    def value(v):
        if v is None:
            return NULL
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(row[i]) for i in order) for row in rows), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df, want = catalogue.queries()[name](spark, sf), duck.sql(catalogue.oracle_sql()[name])
    assert plain(df.columns, df.collect()) == plain(want.columns, want.fetchall())


def test_sql_only_for_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_entry_names_are_callables():
    assert all(callable(f) for f in entry.queries().values())
    assert set(entry.oracle_sql()) <= set(entry.queries())
