import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from vitals.session import local_session
    s = local_session(cpus="*", shuffle_partitions=8, app="vitals-tests")
    yield s
    s.stop()
