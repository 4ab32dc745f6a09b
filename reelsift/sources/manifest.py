"""Which videos to work on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.functions.naming import is_video


def video_manifest(paths: DataFrame, dedupe: bool = True) -> DataFrame:
    """Paths with a video ending, in any case; each once unless ``dedupe`` is off."""
    videos = paths.select("path").filter(is_video(F.col("path")))
    return videos.dropDuplicates(["path"]) if dedupe else videos


def list_videos(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """Manifest of the files matching paths or globs; a pattern without match adds nothing.

    Patterns that match are one scan. Only names and sizes are read: the content column is pruned.
    """
    present = []
    for pattern in patterns:
        try:
            spark.read.format("binaryFile").load(pattern)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            present.append(pattern)
    if not present:
        return spark.createDataFrame([], "path STRING, length BIGINT")
    files = spark.read.format("binaryFile").load(present).select("path", "length")
    return files.filter(is_video(F.col("path"))).dropDuplicates(["path"])
