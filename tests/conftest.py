import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from sprigwork.session import build_session  # noqa: E402
from sprigwork.tables import workers_find_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    workers_find_package(session)
    yield session
    session.stop()
