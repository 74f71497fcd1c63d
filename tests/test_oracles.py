"""Every query runs; those with SQL give the same rows as DuckDB on the same tables."""

import duckdb
import pytest

from sonolith.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, tiny, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got
    if name in ORACLES:
        found = con.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _same_as_sql(spark, name, d, table):
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{d}/{table}.parquet'")
    df = QUERIES[name](spark, d)
    columns = sorted(df.columns)
    found = c.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    want = sorted(repr(tuple(r[names.index(x)] for x in columns)) for r in found.fetchall())
    assert want and sorted(repr(tuple(r[x] for x in columns)) for r in df.collect()) == want


def _plateaus(tiny, d):
    """Every event twice, one after the other, so that peaks have neighbours of the same height."""
    duckdb.sql(f"copy (select event_id * 2 + k as event_id, ts, user_id, event_type, value, props from '{tiny}/events.parquet', range(2) t(k)) to '{d}/events.parquet'")


def test_beats_minimal_on_plateaus(spark, tiny, tmp_path):
    _plateaus(tiny, tmp_path)
    _same_as_sql(spark, "beats_minimal", str(tmp_path), "events")


def test_beats_times_on_plateaus(spark, tiny, tmp_path):
    _plateaus(tiny, tmp_path)
    _same_as_sql(spark, "beats_times", str(tmp_path), "events")


def test_output_paths_of_equal_urls(spark, tiny, tmp_path):
    """Of pages with one path the first keeps its output, however the rows lie; no row goes."""
    duckdb.sql(f"copy (select page_id + 60 * k as page_id, url, html from '{tiny}/pages.parquet', (values (0), (1), (2), (2)) t(k) order by hash(page_id * 7 + k)) to '{tmp_path}/pages.parquet' (row_group_size 10)")
    rows = QUERIES["output_paths"](spark, str(tmp_path)).collect()
    n = duckdb.sql(f"select count(*) from '{tiny}/pages.parquet'").fetchall()[0][0]
    assert len(rows) == 4 * n
    assert all(r["page_id"] < 60 for r in rows if not r["clash"]) and len({r["output"] for r in rows}) == sum(not r["clash"] for r in rows)
