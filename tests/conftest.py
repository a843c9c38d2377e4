import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from attesta.session import get_spark, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(master="local[4]", shuffle_partitions=4, driver_memory="4g")
    ship(session)
    return session
