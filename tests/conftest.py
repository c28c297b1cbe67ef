import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import importable, session

    s = session("tests", memory="4g")
    importable(s)
    return s


def one(df, *columns):
    """The rows of a few columns, sorted."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
