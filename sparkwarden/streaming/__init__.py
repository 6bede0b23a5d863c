"""Moderation of streams, with running totals and windowed limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.moderate import ModerateOptions, moderate


def stream(df: DataFrame, sink: str, checkpoint: str, options: ModerateOptions = ModerateOptions(), text_column: str = "text", id_column: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Results of a stream as Parquet files, each record just once.  ``query.stop()`` aborts."""
    if options.max_calls is not None:
        raise ValueError("a call budget spans batches: use moderated_batches")
    writer = moderate(df, options, text_column, id_column).drop("index").writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def moderated_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, options: ModerateOptions = ModerateOptions(), text_column: str = "text", id_column: str | None = None) -> StreamingQuery:
    """``each(results, batch_id)`` for every batch; a call budget runs on from batch to batch, and after a restart from the same checkpoint.

    What has been spent by the end of each batch is written beside the checkpoint by the batch's number, so a batch that is
    run again is counted once.  Calls of a batch that was cut off halfway are made again and not counted twice."""
    from dataclasses import replace

    ledger = checkpoint.rstrip("/") + ".calls"

    def run(batch: DataFrame, number: int) -> None:
        before = _spent(batch.sparkSession, ledger, number - 1) if options.max_calls is not None else 0
        own = options if options.max_calls is None else replace(options, max_calls=max(0, options.max_calls - before))
        results = moderate(batch, own, text_column, id_column).persist()
        each(results, number)
        if options.max_calls is not None:
            calls = results.where("ai is not null and ai.status <> 'skipped'").count()
            batch.sparkSession.createDataFrame([(before + calls,)], "spent long").coalesce(1).write.mode("overwrite").json(f"{ledger}/{number}")
        results.unpersist()

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _spent(spark: SparkSession, ledger: str, number: int) -> int:
    """Calls made up to the end of batch ``number``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{number}")
    if number < 0 or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return 0
    return spark.read.schema("spent long").json(f"{ledger}/{number}").first()["spent"]


def running_totals(results: DataFrame) -> DataFrame:
    """For ``complete`` mode: one row of counts."""
    return results.agg(F.count(F.lit(1)).alias("processed"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.sum(F.size("pii").cast("long")).alias("pii_findings"))


def over_limit(df: DataFrame, key: str, at: str, most: int = 20, window: str = "1 minute", late: str | None = None) -> DataFrame:
    """``window_start, <key>, requests``: keys with more than ``most`` rows in a tumbling window."""
    rows = df.withWatermark(at, late) if late else df
    counted = rows.groupBy(F.window(at, window).alias("w"), key).agg(F.count(F.lit(1)).alias("requests"))
    return counted.where(F.col("requests") > most).select(F.col("w.start").alias("window_start"), key, "requests")


class Progress(StreamingQueryListener):
    """Calls ``tell(rows so far, rows per second)`` whenever ``every`` more rows have come, and once at the end."""

    def __init__(self, tell: Callable[[int, float], None], every: int = 500):
        self.tell, self.every, self.rows, self.told, self.speed = tell, max(1, every), 0, 0, 0.0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.speed = event.progress.processedRowsPerSecond
        if self.rows // self.every > self.told // self.every:
            self.told = self.rows
            self.tell(self.rows, self.speed)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        self.tell(self.rows, self.speed)
