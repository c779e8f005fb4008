import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomspan.plans.lineage import session

    s = session("tests", cores=4, shuffle_partitions=4, **{"spark.driver.memory": "4g", "spark.default.parallelism": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
