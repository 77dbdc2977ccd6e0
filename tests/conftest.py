import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from maskloom.runtime import session  # noqa: E402

KEY = "00112233445566778899aabbccddeeff"


@pytest.fixture(scope="session")
def spark():
    return session("tests", cores="4", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def key():
    return KEY
