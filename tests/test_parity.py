"""Every query of the engine against its SQL, over the smallest tables."""

import pytest

from lodestone.parity import compare
from lodestone.plans import registry
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLES:
        ok, what = compare(df, registry.ORACLES[name], SMALL)
        assert ok, what
    else:
        assert len(df.collect()) > 0


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
