from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from lorequarry.shared import build_session

    os.environ.setdefault("PYTHONPATH", str(ROOT))
    session = build_session(
        "tests", "8", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
