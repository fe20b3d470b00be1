import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    scratch = tempfile.mkdtemp(prefix="nomen-test-")
    s = (SparkSession.builder.master("local[4]").appName("nomen-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.local.dir", scratch)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # tests only: no cluster-provided checkpoint folder, so set our own
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        try:
            s.conf.set("spark.checkpoint.dir", os.path.join(scratch, "ckpt"))
        except Exception:  # a core conf may be read-only at runtime
            s.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    yield s


@pytest.fixture()
def tmpdir_path(tmp_path):
    return str(tmp_path)
