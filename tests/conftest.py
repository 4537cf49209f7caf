import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from litflow.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    s = local_session("litflow-tests", "4", 4)
    ship_package(s)
    yield s
    s.stop()
