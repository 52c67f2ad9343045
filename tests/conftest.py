import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from gaugework import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("gaugework-tests", 8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
