from __future__ import annotations

import pytest

from tallyloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def rows():
    return lambda df: sorted(tuple(r) for r in df.collect())
