import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from choicelens.session import get_spark
    s = get_spark(app="choicelens-tests", master="local[4]", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="cl-test-ckpt-"),
                         "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="cl-test-warehouse-"),
                         "spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="cl-test-")


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all if none)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((v is None, str(v)) for v in t))
