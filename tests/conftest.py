from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cohortflow.session import configure  # noqa: E402
from tools.check import database, session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("4")
    yield configure(s)
    s.stop()


@pytest.fixture(scope="session")
def base() -> str:
    return SF


@pytest.fixture(scope="session")
def duck():
    return database(SF)
