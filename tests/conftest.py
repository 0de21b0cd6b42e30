import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reelgraph.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="reelgraph-tests-")
    session = build_session("tests", 8, **{
        "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": f"{folder}/checkpoint",
        "spark.sql.streaming.checkpointLocation": f"{folder}/streams",
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
