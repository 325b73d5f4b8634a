import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TESSERA_SHUFFLE_PARTITIONS", "4")
    from tessera.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app="tessera-tests")
    yield s
    s.stop()
