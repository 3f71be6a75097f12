"""One local session for all tests."""

import gc
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidewright.session import local_session

    return local_session(4, memory="4g", partitions=4)


@pytest.fixture(autouse=True)
def clean(request):
    """After a test, let go of its cached tables and broadcasts, so the session's heap lasts for all tests."""
    yield
    if "spark" in request.fixturenames:
        spark = request.getfixturevalue("spark")
        spark.catalog.clearCache()
        runtime = spark._jvm.java.lang.Runtime.getRuntime()
        if runtime.totalMemory() - runtime.freeMemory() > 1 << 30:
            gc.collect()
            spark._jvm.java.lang.System.gc()
