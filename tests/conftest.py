import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from turnstile.session import get_spark
    s = get_spark("tests", cpus=4, shuffle_partitions=8)
    yield s
    s.stop()


def pages_df(spark, pages):
    return spark.createDataFrame([(i, f"fixture://{i}", h) for i, h in pages],
                                 "page_id long, url string, html string")
