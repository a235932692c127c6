import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from survspan.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8)
    yield s


def rows(df, cols=None):
    """Sorted list of tuples for order-free comparison (floats rounded)."""
    cols = cols or df.columns
    out = []
    for r in df.select(*cols).collect():
        out.append(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))
