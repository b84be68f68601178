from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from measurekit.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                                  "spark.checkpoint.dir": tempfile.mkdtemp(prefix="measurekit-tests-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
