import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from corvane.session import get_spark, ship

    s = get_spark("tests", "8")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
