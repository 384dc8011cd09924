"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest

from panelworks.workload.catalog import load

SF = "/root/testdata/sf0.001"
CATALOG = load()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, SF, CATALOG[name]) is None


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "entity_frame" in e.queries()
