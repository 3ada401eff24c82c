"""Tables that cut a plan's lineage: written to the folder that all executors share, read back, and deleted when superseded."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Setting that deletes the shuffles of a statement at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the master is local, a temporary folder of this session."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.helixloom.scratch", None)
    if not found:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-helixloom-")
        spark.conf.set("spark.helixloom.scratch", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """The table written and read back; if this is the `last` use of df, the shuffles behind it are deleted at once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    was = conf.get(TIDY, None)
    if last:
        conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if last:
            conf.set(TIDY, was) if was is not None else conf.unset(TIDY)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that `stored` made, once nothing reads them any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
