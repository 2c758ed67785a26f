import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__  # noqa: F401  (task code is pickled by value)
from folioscope.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "folioscope-tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
