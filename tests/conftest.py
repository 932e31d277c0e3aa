import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assay.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8)
    if session.conf.get("spark.checkpoint.dir", None) is None:
        from assay import session as s
        s._LOCAL_FOLDERS[session.sparkContext.applicationId] = tempfile.mkdtemp(prefix="assay-tests-")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
