"""Session and checkpoint-directory helpers.

Library code never creates its own session: every public function takes a
DataFrame (or a SparkSession) from the caller.  ``local_session`` exists for
tests, ``bench.py`` and the examples only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "sparkscout") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARKSCOUT_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    Order: a directory already set on the SparkContext, then the cluster's
    ``spark.checkpoint.dir`` setting.  Only a local-mode session (tests,
    bench) may fall back to a fresh scratch folder; on a cluster a missing
    setting is an error, because a machine-local folder does not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="sparkscout-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a shared folder "
        "(HDFS/S3/ABFS) before running iterative operators")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint that cuts the lineage of small loop state."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCOPES: list[list[str]] = []


def register(path: str) -> str:
    """Note a table of the shared folder in the innermost scope, if any."""
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark: SparkSession):
    """Intermediate tables written inside are deleted at the end, whatever
    happens; what is to last has to be written to a path of its own before."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for p in paths:
            remove(spark, p)


def stored(df: DataFrame, name: str = "state") -> DataFrame:
    """Write a frame to the shared checkpoint folder as Parquet and read it
    back: cuts the lineage, survives lost executors, and later passes read
    only the columns they need."""
    path = register(f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
