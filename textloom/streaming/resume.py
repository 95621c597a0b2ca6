"""Resumable documenting: new files of a folder are worked on once, however often the job is started."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def document_new_files(spark: SparkSession, folder: str, out: str, progress: str, document: Callable[[DataFrame], DataFrame], max_lines: int = 200):
    """Starts a query over the text files of ``folder``, with its progress in the folder ``progress``; it ends once all that is there is done.

    ``document`` gets (file, text) and returns rows; these are written as Parquet, each batch under its own number, so a batch that runs
    again replaces itself. Files of more than ``max_lines`` lines aren't documented at once: their names and sizes (file, lines) are written to ``<out>-long`` in the same
    way, for ``histories.document_blocks``, which takes a file block by block.
    """
    files = spark.readStream.schema("value string").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        lines = F.size(F.split("text", "\n"))
        document(batch.filter(lines <= max_lines)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.filter(lines > max_lines).select("file", lines.alias("lines")).write.mode("overwrite").parquet(f"{out.rstrip('/')}-long/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
