import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larkspur.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
