import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from playlens.session import get_session
    os.environ.setdefault("PLAYLENS_SHUFFLE_PARTITIONS", "8")
    s = get_session("local[8]", "playlens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def T(spark):
    """The hand-worked triplets of FIXTURES.md section 3 (users and items as ints).

    u1=1, u2=2, u3=3; a=1, b=2, c=3, d=4.
    """
    rows = [(1, 1, 12), (1, 2, 1), (1, 3, 3), (2, 1, 2), (2, 2, 5), (3, 3, 11), (3, 4, 4)]
    return spark.createDataFrame(rows, "user_id BIGINT, item_id BIGINT, play_count INT")


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
