"""Compares a query with its SQL, order aside."""

import os

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def assert_same(got, wanted) -> None:
    assert sorted(got.columns) == sorted(wanted.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(wanted)
