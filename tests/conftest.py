import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelprism.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    # spark.checkpoint.dir comes from the session's configuration; get_spark
    # invents a local folder only when none is configured (local mode only)
    s = get_spark("local[4]", app="labelprism-tests", shuffle_partitions=4,
                  extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()
