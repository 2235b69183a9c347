"""Content statistics that are kept up to date while reads arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.reads import content_stats

READS = "read_id long, name string, seq string, qual string"


def stream_reads(spark: SparkSession, path: str, files_per_batch: int = 64, glob: str = "*.parquet") -> DataFrame:
    """A stream over the Parquet files of reads in a folder; a batch takes no
    more than so many files, which bounds what is under way."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(path)


def running_stats(reads: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps one row of statistics in a Parquet folder, written anew with each
    batch. The state is one row of sums and does not grow with the input.
    A file that is cut off fails its batch, which then leaves no trace; the
    batches before stay. Starting again with the same checkpoint goes on
    where the last committed batch ended. Ends when all files are taken."""

    def keep(frame: DataFrame, batch: int) -> None:
        frame.coalesce(1).write.mode("overwrite").parquet(out)

    return content_stats(reads).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
