import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from crmlake.session import build_session, ensure_checkpoint_dir
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="crmlake-tests")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from seed import SeedTables
    return SeedTables(spark)
