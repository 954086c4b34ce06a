"""Queries against their SQL on the smallest driver tables, where these are at hand."""

import os

import pytest

import __spark_entry__ as entry
from tastemill import queries as engine

SF = "/root/testdata/sf0.001"
NAMES = sorted(engine.oracle_sql())


@pytest.fixture(scope="module")
def frames(spark):
    """What many queries read is kept for all of them: their own leases join these."""
    t = engine.Tables(spark, SF)
    t.split_once()
    t.baskets()
    for families in (("genre", "tag"), ("movie", "tag"), ("movie",), ("genre", "movie")):
        t.tokens(families=families)
    yield
    t.scope.release()


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, frames, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = con.sql(entry.oracle_sql()[name])
    own = entry.queries()[name](spark, SF)
    names = sorted(own.columns)
    assert names == sorted(rows.columns)

    def key(values):
        return tuple(round(v, 5) if isinstance(v, float) else v for v in values)

    at = [rows.columns.index(c) for c in names]
    assert sorted(map(repr, (key(r[c] for c in names) for r in own.collect()))) == sorted(map(repr, (key(r[i] for i in at) for r in rows.fetchall())))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["default_seed", "mine_preset_b"])
def test_against_sql_without_rules(spark, tmp_path, name):
    """Nothing is liked by anyone, so that no token is frequent."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        (rows.where("l_quantity <= 5") if t == "lineitem" else rows).write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert entry.queries()[name](spark, str(tmp_path)).collect() == con.sql(entry.oracle_sql()[name]).fetchall() == []
