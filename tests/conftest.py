import os
import sys
import tempfile

import pytest

_HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(_HERE), _HERE]


@pytest.fixture(scope="session")
def spark():
    from twinledger import build_session

    session = build_session(
        "local[8]",
        "twinledger-tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""

    def collect(df, ordered=False):
        found = [tuple(r) for r in df.collect()]
        return found if ordered else sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))

    return collect
