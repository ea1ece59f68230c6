"""Tables saved in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the one the session was given by setCheckpointDir.

    Only a session within one process (tests) may do without: it gets a temporary folder of its own. On a cluster that would be a
    folder of the driver that no executor sees, so there the setting must be given.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", sc.master or ""):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="gradus-shared-")
    return _OWN[sc.applicationId]


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses; it is removed at the end of the driver."""
    path = f"{shared_dir(spark).rstrip('/')}/gradus-{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is read as often as needed.

    The files go at the end of the driver, or before by discard().
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved = spark, path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of saved tables that nothing will read again."""
    for df in tables:
        if getattr(df, "_saved", None):
            remove(*df._saved)
            df._saved = None
