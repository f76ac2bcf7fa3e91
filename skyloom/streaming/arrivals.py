"""Images that keep arriving: a file stream of binary files through the same readers and detection kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyloom.operators import detect
from skyloom.sources import images

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stars(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """A streaming table of the stars of each new image; a file that can't be read gives none."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", max_files).load(folder)
    rows = images._table(files, True).where("status = 'ok'").withColumn("image_id", F.xxhash64("path"))
    return detect._each(rows, lambda img: detect.all_stars(img, 1.5, 500))


def counted(detections: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Stars and mean size of each image so far."""
    return detections.groupBy("image_id").agg(F.count("*").alias("stars"), F.avg("hfd").alias("hfd"))


def to_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends exactly once: Parquet files with a commit log, resumed from the checkpoint."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
