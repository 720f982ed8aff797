import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from grovelight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "grovelight-tests", "6g")
