"""Every registered catalogue query against its SQL on the small tables."""

import duckdb
import pytest

from almanac import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small=None):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    return con


def rows_of(names, rows):
    return sorted((tuple(row[names.index(c)] for c in sorted(names)) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_oracle(spark, db, small, name):
    df = plans.QUERIES[name](spark, small)
    sql = db.sql(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
