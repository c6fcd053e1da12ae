from __future__ import annotations

import os

import duckdb
import pytest

from readloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def shown(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{r[i]:.11g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.execute(SQL[name])
    names = [c[0] for c in wanted.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(wanted.fetchall(), names)


def test_all_have_sql():
    """But for ``align_strings``, which aligns whole documents for minutes; ``test_whole.py`` holds it against a plain version."""
    assert set(QUERIES) - set(SQL) == {"align_strings"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
