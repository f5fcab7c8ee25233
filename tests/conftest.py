import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from scrivener.session import get_session
    s = get_session("local[4]", shuffle_partitions=8, extra={
        "spark.sql.shuffle.partitions": "8",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="scrivener-test-ckpt-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="scrivener-test-wh-"),
    })
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="scrivener-test-")
