import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from siftwell.session import build_session

    session = build_session("tests", master="local[4]", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no driver tables here")
    return str(path)
