import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from ctrltok.session import DEFAULT_CONF, checkpoint_dir

    b = SparkSession.builder.master("local[4]").appName("ctrltok-tests")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = (b.config("spark.sql.shuffle.partitions", "8")
          .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ctrltok-test-ckpt-", dir="/tmp"))
          .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="ctrltok-test-wh-", dir="/tmp"))
          .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="ctrltok-test-", dir="/tmp")
