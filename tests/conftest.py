import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vectables.session import local_session, ship_package, storage_root

    s = local_session(cores=8, shuffle_partitions=8, app="vectables-tests")
    storage_root(s)  # shared folder from the session; a temp one only in local mode
    ship_package(s)
    yield s
