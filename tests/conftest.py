import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from thinkframe.session import local_session

    s = local_session("*", 8, app="thinkframe-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as a list of tuples, in DataFrame order."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
