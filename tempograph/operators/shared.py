"""Writing intermediate tables where all executors find them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is named, one of our own if all runs on this machine, else an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = OWN.get(context.applicationId) or OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tempograph-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tempograph/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder: the lineage ends here, and a lost executor costs a re-read."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that written() made and that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for file in {os.path.dirname(f) for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
