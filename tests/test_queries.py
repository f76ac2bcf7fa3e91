"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from skyloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, small, db, name):
    df = catalogue.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    rel = db.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert set(got) == set(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, small, name):
    df = catalogue.queries()[name](spark, small)
    assert df.columns and df.count() >= 0


def test_entry_solves_its_fields(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(abs(r["ra0"] - 1.5) < 1e-3 and abs(r["dec0"] - 0.3) < 1e-3 and abs(r["cdelt2"] * 3600 - 3) < 0.01 for r in rows)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


PIXEL_QUERIES = "p01_normalise p02_bin p03_debayer b01_histogram b02_clipped_mean b03_background_mode b04_noise b05_star_levels".split()


@pytest.fixture(scope="module")
def many_events(tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    duckdb.sql(f"copy (select range as event_id, 5e0 + (range * 7919 % 10007) / 100e0 + (range // 5000) * 3 as value from range(22500)) to '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", PIXEL_QUERIES)
def test_pixels_are_those_of_all_events(spark, many_events, name):
    df = catalogue.queries()[name](spark, many_events)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    sql = catalogue.oracle_sql()[name]
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{many_events}/events.parquet'")
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    assert len({r[columns.index("image_id")] for r in got}) == 5
