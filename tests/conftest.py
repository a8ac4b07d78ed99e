import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

@pytest.fixture(scope="session")
def spark():
    from annospark.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="annospark-tests", shuffle_partitions=8)
    checkpoint_dir(s)   # unset in tests: a private scratch folder is registered
    yield s
    s.stop()
