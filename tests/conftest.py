import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from brindle.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8", spark__sql__shuffle__partitions="4", spark__sql__streaming__stateStore__maintenanceInterval="500ms")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Frame to a sorted list of plain tuples."""

    def collect(df, *cols):
        return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())

    return collect
