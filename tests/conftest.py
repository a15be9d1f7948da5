import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from notarium.session import local_session

    session = local_session(8, "tests")
    session.conf.set("spark.sql.maxPlanStringLength", "2000")
    yield session
    session.stop()


@pytest.fixture
def small_buckets(monkeypatch):
    """Buckets so narrow that every scan crosses many of them."""
    from notarium.operators import scan

    monkeypatch.setattr(scan, "CLOCK_BITS", 3)
    monkeypatch.setattr(scan, "TICK_BITS", 3)
    monkeypatch.setattr(scan, "SEQ_BITS", 1)
