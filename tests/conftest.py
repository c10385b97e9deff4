import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.runtime import session

    s = session(8, 8, driver_memory="6g", spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def same():
    """Rows of a DataFrame as a sorted list of tuples by sorted column names."""

    def rows(df):
        cols = sorted(df.columns)
        return sorted((tuple(str(r[c]) for c in cols) for r in df.collect()))

    return rows
