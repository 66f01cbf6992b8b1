"""Every registered grid query against its SQL, with rows of both kinds."""

import duckdb
import pytest

from seagrid.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "nation customer orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rounded(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    found = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = found.fetchall()
    assert rounded([r[c] for c in columns] for r in df.collect()) == rounded(want)


def test_point_values_are_mixed(spark):
    rows = QUERIES["point_nearest"](spark, DATA).collect()
    assert {r.value is None for r in rows} == {True, False}


def test_altered_tie_rule_would_show(spark, db):
    rows = QUERIES["point_descending_tie"](spark, DATA).collect()
    assert any(r.rising != 24 - r.falling for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2400
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
