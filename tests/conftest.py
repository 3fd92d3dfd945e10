import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from scriptorium.session import session

    return session(f"local[{os.environ.get('TEST_CPUS', '8')}]", 8, "tests", **{"spark.driver.memory": "6g"})
