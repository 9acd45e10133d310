"""Every query of the core with SQL gives the same rows as DuckDB, on the smallest tables."""

import os

import oracle
import pytest

from quirelake.plans import registry

SF = os.environ.get("QUIRELAKE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


#: queries that the smallest tables may have no row for
MAY_BE_EMPTY = {"typst_subchunks", "boundary_pieces", "example_gate", "segments_typst", "chunks_typst", "ph_only_chunks"}


@pytest.fixture(scope="module")
def con():
    connection = oracle.connect(SF)
    connection.execute("set timezone = 'UTC'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert oracle.differences(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    """Queries without SQL: rows where the tables have any, no nulls in their keys, no row twice."""
    df = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert (rows or name in MAY_BE_EMPTY) and all(r[0] is not None for r in rows) and len(set(rows)) == len(rows)


def test_entry_module():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
