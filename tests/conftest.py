import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from fieldnote.session import build_session

    session = build_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, *order):
    """Rows as tuples, sorted by the given columns or by all."""
    got = [tuple(r) for r in df.collect()]
    if not order:
        return sorted(got, key=repr)
    at = [df.columns.index(c) for c in order]
    return sorted(got, key=lambda r: [repr(r[i]) for i in at])
