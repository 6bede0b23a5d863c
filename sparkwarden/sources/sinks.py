"""Results out: NDJSON, the flagged projection without texts, and a keyed store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode(mode).json(path)


def flagged_output(results: DataFrame, every: bool = False) -> DataFrame:
    """What is told of results: positions and grades, never texts."""
    found = F.transform("pii", lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    verdict = F.when(F.col("ai").isNotNull(), F.struct("ai.status", "ai.flagged", "ai.severity"))
    rows = results if every else results.where("flagged")
    return rows.select("index", "id", "flagged", "matched_list", found.alias("pii"), verdict.alias("ai"), "error")


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, version: str) -> None:
    """A Parquet table by key: of rows with one key the latest version stays.

    Written beside the old table, which is moved aside, not deleted, until the new one is in its place."""
    where = lambda suffix="": spark._jvm.org.apache.hadoop.fs.Path(path + suffix)
    files = where().getFileSystem(spark._jsc.hadoopConfiguration())
    _repaired(files, where)
    old = spark.read.parquet(path).unionByName(rows, allowMissingColumns=True) if files.exists(where()) else rows
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    old.withColumn("__n", latest).where("__n = 1").drop("__n").write.mode("overwrite").parquet(path + ".next")
    if files.exists(where()) and not files.rename(where(), where(".old")):
        raise OSError(f"{path} can't be moved aside")
    if not files.rename(where(".next"), where()):
        files.rename(where(".old"), where())
        raise OSError(f"the new table can't be put in the place of {path}")
    files.delete(where(".old"), True)


def _repaired(files, where) -> None:
    """A change that was cut off between its two renames is undone."""
    if files.exists(where(".old")):
        if files.exists(where()):
            files.delete(where(".old"), True)
        else:
            files.rename(where(".old"), where())


def get(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col(key) == value)


def listed(spark: SparkSession, path: str, where: str | None = None, order_by: str | None = None, most: int | None = None) -> DataFrame:
    """The rows of the table, or those for which the SQL condition ``where`` holds."""
    rows = spark.read.parquet(path)
    rows = rows.where(where) if where else rows
    rows = rows.orderBy(F.desc(order_by)) if order_by else rows
    return rows.limit(most) if most is not None else rows
