import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from keystride import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    found = session.build("local[4]", 4)
    found.sparkContext.setLogLevel("ERROR")
    return found


@pytest.fixture(scope="session")
def sf():
    return SF
