"""Spark session and cluster settings used by the library."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings the library relies on.  On a cluster they come from the job's
# configuration; ``local_session`` applies them for tests and benchmarks.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Per-chunk summary tables are small; AQE broadcasts them only when the
    # runtime size is below this bound.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "repsight") -> SparkSession:
    """A local session for tests and benchmarks (UI off, no ports beyond Spark's own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> str:
    """Checkpoint folder plus the package shipped to the Python workers."""
    path = ensure_checkpoint_dir(spark)
    ship_package(spark, path)
    return path


def ship_package(spark: SparkSession, folder: str) -> None:
    """Zip this package into ``folder`` and ``addPyFile`` it, once per application.

    Python workers import the package for the pandas functions of the
    streaming operators; on a cluster they have no access to the driver's
    source tree.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    local_folder = folder[len("file:"):] if folder.startswith("file:") else folder
    target = os.path.join(local_folder, f"repsight-{app}.zip") if os.path.isdir(local_folder) else os.path.join(
        tempfile.mkdtemp(prefix="repsight-pkg-"), "repsight.zip"
    )
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is.  On a cluster it
    must be set.  Only where it is unset on a local master (tests) a scratch folder is created and registered.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="repsight-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
