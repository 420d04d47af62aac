import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corvane import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    yield session.build("local[4]", partitions=4, memory="4g")
