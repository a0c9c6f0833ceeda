import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tillpoint.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="tillpoint-tests",
                      extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


def rows(df, *cols):
    """Rows as sorted tuples (NULLs first) for order-free comparison."""
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))
