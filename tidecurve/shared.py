"""The folder that driver and executors share, and cutting a plan's lineage there.

``spark.checkpoint.dir`` of the session names the folder; only on a local
master, where driver and executors are one process, may it be unset, and then
a folder of our own is made.  Everything written is parquet under a fresh
sub-folder of the application, so a lost executor never loses a copy that only
it held, and ``sweep`` removes what an application has left.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared folder, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("tidecurve.local.shared.dir", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="tidecurve-")
            spark.conf.set("tidecurve.local.shared.dir", root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidecurve/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete all this application has written; call it once its results are read."""
    drop_dir(spark, _own_dir(spark))


#: Spark then deletes the shuffle files of a query as it ends, and not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with ``options`` of the writer, and continue from the written table."""
    path, conf = fresh_dir(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").options(**options).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop(*written: DataFrame) -> None:
    """Delete the folders of tables that ``cut`` wrote and no later step reads."""
    for df in written:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            drop_dir(df.sparkSession, folder)


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: the session's shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
