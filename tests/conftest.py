import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rillet.session import get_session, scratch_dir  # noqa: E402
from rillet.sources.log import TopicLog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="rillet-tests", **{"spark.sql.shuffle.partitions": "8"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def new_log(spark):
    def make(label="t"):
        return TopicLog(spark, scratch_dir(spark, f"test-{label}"))

    return make


def values(df, order=("topic", "partition", "offset")):
    return [r.value if isinstance(r.value, str) else bytes(r.value).decode() for r in df.orderBy(*order).collect()]
