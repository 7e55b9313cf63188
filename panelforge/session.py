"""Spark session and shared-folder helpers.

Everything in the library takes a ``SparkSession``; this module only builds one
for tests and the bench, and resolves the shared folder used for scratch files
and lineage cuts (``spark.checkpoint.dir``).
"""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Conf a cluster job needs regardless of size: AQE re-plans joins from runtime
# sizes (so a small side becomes a broadcast only when it really is small),
# splits skewed shuffle partitions and coalesces tiny ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "panelforge") -> SparkSession:
    """A local session for tests and the bench (UI off, small shuffle count)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    if not SparkSession.getActiveSession():
        b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="panelforge-ckpt-"))
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and is read as is.  Only a local
    session without one gets a fresh folder; on a cluster a folder of the
    driver's own machine would lose rows, so that is an error.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="panelforge-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared checkpoint folder; what is written there goes when the
    application ends."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/panelforge-scratch/{name}-{uuid.uuid4().hex[:12]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: later plans read it
    instead of computing it again, and it survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
