import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortlake.session import build_session

    session = build_session("tests", cores="8", memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from cohortlake.sources.bindings import Tables

    return Tables(spark, SMALL)
