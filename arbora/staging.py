"""Tables written to the folder that driver and executors share, to cut lineages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_unset: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder of the session.

    Where the setting is unset, a temporary folder serves a local session, whose driver and executors are one process; on a
    cluster that would be a folder of each machine by itself, so there the setting is needed.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _unset.get(context.applicationId)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = _unset[context.applicationId] = tempfile.mkdtemp(prefix="arbora-")
    return f"{found.rstrip('/')}/{context.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A folder for a new table there."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it as read from there.

    This cuts the lineage and survives the loss of executors, since no part of the table lives with one of them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_there(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder, wherever paths like this are."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables this application has staged; call it once the results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
