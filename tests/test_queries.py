"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toArrow(), con.sql(entry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = [sorted(map(repr, zip(*(t.column(c).to_pylist() for c in columns)))) for t in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_round_trip_is_whole(spark):
    rows = entry.queries()["backup_restore_roundtrip"](spark, SF).collect()
    assert rows and all(r["same"] for r in rows)


def test_deltas_pay(spark):
    """Chunks with a delta take less than alone, and some have one."""
    from sediment.functions import codec, features
    from sediment.operators import similarity
    from sediment.plans import catalog

    unique = catalog._distinct(spark, SF)
    found = similarity.best_matches(features.with_keys(unique).select("hash", "seq", "keys"))
    bases = unique.selectExpr("hash base_hash", "data base")
    rows = [(bytes(r["data"]), bytes(r["base"])) for r in found.join(unique.select("hash", "data"), "hash").join(bases, "base_hash").collect()]
    deltas = [(d, b, x) for d, b in rows if (x := codec.encode_delta(d, b)) is not None]
    assert deltas and all(len(x) < len(codec.choose_payload(d)[1]) and codec.decode(codec.DELTA, x, b, len(d)) == d for d, b, x in deltas)
