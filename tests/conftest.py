"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from verify import session

    return session()
