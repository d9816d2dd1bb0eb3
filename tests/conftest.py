import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from vitrine.session import build_session
    ckpt = tempfile.mkdtemp(prefix="vitrine-test-ckpt-")
    s = build_session("local[8]", app="vitrine-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def shop_small(spark):
    from vitrine.sources.driver import load_shop
    return load_shop(spark, SF_SMALL)


@pytest.fixture(scope="session")
def shop_mid(spark):
    from vitrine.sources.driver import load_shop
    return load_shop(spark, SF_MID)
