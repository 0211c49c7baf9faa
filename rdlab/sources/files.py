"""Files as tables: listings, image sets, sizes, frames of raw streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files in a folder, not below it; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def image_set(images: DataFrame) -> DataFrame:
    """Distinct paths and their number, the same on every row."""
    paths = images.select("path").distinct()
    return paths.crossJoin(F.broadcast(paths.agg(F.count("*").alias("images"))))


def encoded_size(payload: Column) -> Column:
    return F.octet_length(payload).cast("double")


def fixed_frames(df: DataFrame, id_col: str, content_col: str, size: int) -> DataFrame:
    """(id_col, frame_no, frame): the whole frames of `size` units in each content; a shorter rest is left out."""
    if dict(df.dtypes)[content_col] == "string":
        # one pass over the text; its characters have no fixed places
        frames = F.regexp_extract_all(content_col, F.lit(f"(?s).{{{size}}}"), F.lit(0))
    else:
        n = F.floor(F.length(content_col) / size).cast("int")
        frames = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(content_col), i * size + 1, F.lit(size))))
    return df.select(id_col, F.posexplode(frames).alias("frame_no", "frame"))
