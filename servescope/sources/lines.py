"""Lines of text files by byte range, with their place in the file.

Spark deals a file out in byte ranges and reads the lines that start in each; a file of any size is never
one row or one task. A line's ordinal and bytes follow from its place in its range and from what the
ranges before it hold, which is one small row for each range. Only a line feed ends a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servescope.session import cut


def _raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    return read.select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("range_start"), F.octet_length("value").cast("long").alias("size"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``source_file, line_ordinal, byte_start, byte_end, value, terminated`` of every line.

    Ordinals count from 0; ``byte_end`` is exclusive and leaves the line feed out; ``terminated`` is false
    for a last line without one. Files without a byte have no line.
    """
    # the order of reading inside a range; written once, so that it stays the same for both passes
    lines = cut(_raw(spark, paths).withColumn("place", F.monotonically_increasing_id()))
    ranges = lines.groupBy("source_file", "range_start").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.col("size") + 1).alias("bytes"))
    before = Window.partitionBy("source_file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.select(
        "source_file", "range_start", "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    inside = Window.partitionBy("source_file", "range_start").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = lines.withColumn("inside", F.sum(F.col("size") + 1).over(inside)).join(placed, ["source_file", "range_start"])
    end = F.col("bytes_before") + F.col("inside") - 1
    return ends.select(
        "source_file", (F.col("lines_before") + F.col("place") - F.col("first")).alias("line_ordinal"),
        (end - F.col("size")).alias("byte_start"), end.alias("byte_end"), "value", (end < F.col("file_size")).alias("terminated"))


def unterminated_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files whose last line has no line feed: their lines and feeds count one byte more than the file."""
    counted = _raw(spark, paths).groupBy("source_file", "file_size").agg(F.sum(F.col("size") + 1).alias("bytes"))
    return counted.where("bytes > file_size").select("source_file")
