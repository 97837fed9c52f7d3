import os
import shutil
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark import session

    shared = tempfile.mkdtemp(prefix="tidemark-test-")
    s = session.build("local[4]", 4, **{"spark.checkpoint.dir": shared, "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield s
    s.stop()
    shutil.rmtree(shared, ignore_errors=True)


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
