import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxframe.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, shuffle_partitions=4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    ship_package(s)
    yield s


@pytest.fixture(scope="session")
def tiny():
    """The smallest test tables."""
    return "/root/testdata/sf0.001"
