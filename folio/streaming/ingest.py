"""PDF files as they arrive (an addition; the batch operators know no streams).

A stream of files is parsed file by file. Re-delivered files are told by the digest of their content within a watermark;
counts over time are windowed aggregates; tree walks, which are recursive, run on each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files as ops
from ..plans import tree
from ..scratch import scope
from ..sources import pdf


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, arrived, content`` of new files in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    f = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(path)
    return f.select(F.col("path").alias("doc_id"), F.col("modificationTime").alias("arrived"), "content")


def once(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each content once within the watermark."""
    f = files.withColumn("digest", F.sha2("content", 256)).withWatermark("arrived", late)
    return f.dropDuplicatesWithinWatermark(["digest"])


def page_counts(files: DataFrame, strict: bool = False) -> DataFrame:
    """``doc_id, pages, error`` as a stream."""
    return ops.page_count(files, strict)


def arrivals(files: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """``start, files, bytes`` per window of arrival."""
    w = files.withWatermark("arrived", late).groupBy(F.window("arrived", width))
    return w.agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes")).select(F.col("window.start").alias("start"), "files", "bytes")


def write_geometry(files: DataFrame, target: str, checkpoint: str):
    """Page sizes of arriving files in a table by ``epoch``; returns the running query.

    A batch that is run again writes its own epoch's folder anew, so no row is there twice.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        with scope(df.sparkSession):
            t = pdf.load(df.select("doc_id", "content"), keep=())
            tree.page_geometry(tree.pages(t)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
