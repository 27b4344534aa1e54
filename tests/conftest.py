import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cadence.session import get_spark
    s = get_spark("cadence-tests", 2, shuffle_partitions=4)
    yield s
    s.stop()


def rows(df, *cols, order=None):
    """Collect selected columns as tuples, ordered."""
    d = df.select(*cols) if cols else df
    d = d.orderBy(*(order or d.columns))
    return [tuple(r) for r in d.collect()]
