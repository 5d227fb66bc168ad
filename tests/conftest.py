import os
import sys
import tempfile

import pytest

try:  # keep hypothesis's caches out of the working directory
    from hypothesis.configuration import set_hypothesis_home_dir

    set_hypothesis_home_dir(tempfile.mkdtemp(prefix="sluice-hypothesis-"))
except ImportError:  # pragma: no cover
    pass

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sluice.session import local_session

    # catalog tables made by tests go to a temp folder, not into the working directory
    s = local_session("*", shuffle_partitions=8, app="sluice-tests", warehouse_dir=tempfile.mkdtemp(prefix="sluice-wh-"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from sluice.session import scratch_path

    return lambda name="t": scratch_path(spark, name)
