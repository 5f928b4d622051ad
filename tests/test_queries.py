"""Registered queries against their SQL, and shape checks of the plans."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from labelscope.plans import queries as Q

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_matches_sql(spark, duck, name):
    frame = driver.queries()[name](spark, str(DATA))
    columns = sorted(frame.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    result = duck.execute(driver.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    want = sorted(tuple(str(r[order.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_audits_add_no_exchange(spark):
    assert plan(Q.label_counts(spark, str(DATA))).count("Exchange") == 1
    # Pairing looks at the next turn and, for the last turn of a block, at the next block.
    assert plan(Q.boundary_classes(spark, str(DATA))).count("Exchange hashpartitioning(conv_id") <= 4
    assert plan(Q.token_lengths(spark, str(DATA))).count("Exchange") == 0


def test_no_cross_joins(spark):
    for query in (Q.truncation_sweep, Q.input_matrix, Q.file_drift, Q.supplied_label_audit):
        text = plan(query(spark, str(DATA)))
        assert "NestedLoop" not in text and "Cartesian" not in text
