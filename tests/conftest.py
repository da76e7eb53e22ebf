import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from claimsieve.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("claimsieve-tests", cores=8, shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
