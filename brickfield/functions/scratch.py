"""Tables in the shared folder that the session names; writing one cuts a long lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of this driver's tables in each shared folder.
_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this driver's own in that of spark.checkpoint.dir; it is removed when the driver ends.

    Where the setting is absent, a local master gets a temporary folder and a cluster must set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="brickfield-")
        spark.conf.set("spark.checkpoint.dir", base)
    if base not in _folders:
        _folders[base] = f"{base.rstrip('/')}/brickfield-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[base])
    return _folders[base]


def _remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder while the session's JVM still runs; what a stopped one leaves is the shared folder's to clear."""
    try:
        remove(spark, folder)
    except Exception:  # the JVM is gone
        pass


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
