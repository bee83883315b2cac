import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tillscope.session import local_session

    shared = "file://" + tempfile.mkdtemp(prefix="tillscope-shared-", dir="/tmp")
    s = local_session(cpus="*", shuffle_partitions=8,
                      extra={"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tillscope-test-", dir="/tmp")
