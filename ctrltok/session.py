"""Session construction and the shared checkpoint folder.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a
shared folder; we only read it.  A local default is set only when the setting
is absent (tests, local benches).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: adaptive execution (runtime join selection,
# partition coalescing, skew-join splitting), Arrow for pandas UDFs, and a UTC
# session clock.  Broadcast joins are chosen by AQE from measured runtime sizes
# under this threshold only; nothing in the library forces a broadcast of a
# table whose size grows with the data.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "ctrltok") -> SparkSession:
    """Return the active session, or build a local one with the library defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CTRLTOK_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ctrltok-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet into the shared checkpoint folder and read
    it back: lineage is cut, the data is computed exactly once, a lost executor
    re-reads instead of recomputing, and the read-back scan carries file-size
    statistics for AQE's join planning."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_materialized(spark: SparkSession) -> None:
    """Remove every table :func:`materialize` wrote in this application; DataFrames that read one end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> str:
    """Make ``ctrltok`` importable on executors (the pandas UDFs are pickled by
    reference): zip the package once and add it with ``addPyFile`` -- the
    programmatic form of ``spark-submit --py-files``.  Not needed when the
    package is installed on the executors' image."""
    import shutil

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="ctrltok-pkg-")
    archive = shutil.make_archive(os.path.join(out, "ctrltok"), "zip", root_dir=os.path.dirname(pkg), base_dir="ctrltok")
    spark.sparkContext.addPyFile(archive)
    return archive
