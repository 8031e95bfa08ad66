import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from knownwhen.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s
