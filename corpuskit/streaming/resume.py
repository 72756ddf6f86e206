"""Outcome records as a stream: new files of a folder, each (task, sample) once, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskit.sources.readers import RECORD


def record_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Whole records of the folder's files; torn lines are skipped."""
    lines = spark.readStream.schema(RECORD).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return lines.where(F.col("task_id").isNotNull() & F.col("sample").isNotNull())


def append_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each (task, sample) that the table hasn't yet, appended once.

    Whether a key is new is known to the stream's own state store, keyed by (task, sample), so that no batch reads what was written before. The
    batch's number names its folder, so a batch that is done again after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    first = stream.dropDuplicates(["task_id", "sample"])
    return first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shape_once(stream: DataFrame, key: str = "shape", time: str = "at", lateness: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark, which bounds the state."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
