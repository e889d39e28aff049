import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lodeseam.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return ship(local_session(4, 4, "4g"))
