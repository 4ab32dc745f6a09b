"""How fast streams go, measured batch by batch and kept in a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from reelsift.streaming import store

METRIC = "processed"
RATES = "query string, processed_frames long, seconds double"


def observed(frames: DataFrame) -> DataFrame:
    """``frames``, counted as they pass. A stream of them tells ``RateListener`` how many each batch had."""
    return frames.observe(METRIC, F.count(F.lit(1)).alias("frames"))


class RateListener(StreamingQueryListener):
    """Writes a row for each micro-batch of ``observed`` frames: the frames it had and the time it took.

    A batch that is reported again, after a restart, is written once. One listener serves one path and one
    query at a time; the table goes on over restarts on the same checkpoint.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._ended = spark, path, threading.Event()

    def onQueryStarted(self, event) -> None:
        self._ended.clear()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        counted = progress.observedMetrics.get(METRIC)
        if counted is not None and counted["frames"]:
            seconds = progress.durationMs["triggerExecution"] / 1000
            row = self.spark.createDataFrame([(str(progress.id), counted["frames"], seconds)], RATES)
            store.append(row.coalesce(1), self.path, progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.set()

    def finish(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait for the query's end and for its last batch to be written."""
        query.awaitTermination()
        if not self._ended.wait(seconds):
            raise TimeoutError("the end of the query was not reported")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """``batch, query, processed_frames, seconds, processing_fps``, 0 frames a second where no time was taken."""
    fps = F.when(F.col("seconds") > 0, F.col("processed_frames") / F.col("seconds")).otherwise(F.lit(0.0))
    return spark.read.parquet(path).withColumn("processing_fps", fps)
