import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from crosstape.session import build_session

    s = build_session("crosstape-tests", master="local[8]", cores=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
