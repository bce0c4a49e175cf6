import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from repsight.session import RECOMMENDED_CONF

    ckpt = tempfile.mkdtemp(prefix="repsight-test-ckpt-")
    b = (
        SparkSession.builder.master("local[*]")
        .appName("repsight-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", ckpt)
    )
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ckpt)
    from repsight.session import prepare

    prepare(s)
    yield s
    s.stop()
