"""Intermediate tables in the folder that all executors share.

All tables of an application lie in one folder of its own below ``spark.checkpoint.dir``.  What
is known to be read no more goes at once (:func:`dropped`); the rest goes when the driver ends,
or by :func:`cleared`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, as the cluster names it.

    Where it is unset a folder of our own is made and set, but only if all executors run on this machine; on
    a cluster each would write to a disk of its own, so that raises ``RuntimeError``."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sparkwarden-")
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/sparkwarden-{spark.sparkContext.applicationId}"
    files, where = _files(spark, path)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return path


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and ``path`` as it names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts its lineage: a lost executor costs a read of the table, not a new computation."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`stored` wrote, when nothing reads them any more."""
    spark = df.sparkSession
    own = folder(spark).split(":")[-1].lstrip("/")
    for file in df.inputFiles()[:1]:
        path = file.rpartition("/")[0]
        if own in path:
            files, where = _files(spark, path)
            files.delete(where, True)


def cleared(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application: when no result is to be read any more."""
    files, where = _files(spark, folder(spark))
    files.delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it new to ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
