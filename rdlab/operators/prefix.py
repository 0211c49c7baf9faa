"""Running sums along sequences of any length: sums of blocks first, then the sums before each block, then within blocks.

A block is the frames of a sequence whose numbers share floor(frame / block). Rows meet by (seq, block), so a long sequence
lies in many tasks; only one row for each block meets by sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 100_000  #: frame numbers of a block


def _blocks(frames: DataFrame, block: int) -> DataFrame:
    return frames.withColumn("__block", F.floor(F.col("frame") / block).cast("long"))


def running(frames: DataFrame, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """frames (seq, frame, ...) with running sums up to each frame, named by `sums`; frames of a sequence have distinct whole numbers. Nulls add nothing, and a sum over nulls only is null; null sequences are one sequence."""
    rows = _blocks(frames.withColumns({f"__{k}": c for k, c in sums.items()}), block)
    of_block = rows.groupBy("seq", "__block").agg(*[F.sum(f"__{k}").alias(f"__{k}_all") for k in sums])
    before = Window.partitionBy("seq").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    start = of_block.select("seq", "__block", *[F.sum(f"__{k}_all").over(before).alias(f"__{k}_before") for k in sums])
    start = start.withColumnsRenamed({"seq": "__seq", "__block": "__at"})
    joined = rows.join(start, F.col("seq").eqNullSafe(F.col("__seq")) & (F.col("__block") == F.col("__at")))
    within = Window.partitionBy("seq", "__block").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    plus = lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return joined.select(*frames.columns, *[plus(F.col(f"__{k}_before"), F.sum(f"__{k}").over(within)).alias(k) for k in sums])


def previous(frames: DataFrame, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """frames with the value of the frame before in the same sequence, across borders of blocks; null for the first."""
    rows = _blocks(frames, block)
    last = rows.groupBy("seq", "__block").agg(F.max_by(F.struct(value), "frame").alias("__last"))
    before = Window.partitionBy("seq").orderBy("__block")
    ahead = last.select(F.col("seq").alias("__seq"), F.col("__block").alias("__at"), F.lag("__last").over(before)[value].alias("__carried"))
    joined = rows.join(ahead, F.col("seq").eqNullSafe(F.col("__seq")) & (F.col("__block") == F.col("__at")))
    within = Window.partitionBy("seq", "__block").orderBy("frame")
    first = F.row_number().over(within) == 1
    return joined.select(*frames.columns, F.when(first, F.col("__carried")).otherwise(F.lag(value).over(within)).alias(name))
