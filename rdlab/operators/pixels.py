"""Samples of planes and frames: errors, PSNR, digests, bit-plane conversions, bit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdlab.operators import prefix
from rdlab.operators.digest import fold_digest


def _psnr(sse: Column, n: Column, bits: int, when_equal: Column) -> Column:
    peak = float((1 << bits) - 1)
    return F.when(sse == 0, when_equal).otherwise(F.log10(peak * peak * n / sse) * 10)


def plane_psnr(samples: DataFrame, bits: int = 16, infinite: bool = False) -> DataFrame:
    """(image, plane, samples, sse, psnr) of samples v against w; equal planes have a null PSNR, or Infinity."""
    equal = F.lit(float("inf")) if infinite else F.lit(None).cast("double")
    d = F.col("v") - F.col("w")
    out = samples.groupBy("image", "plane").agg(F.count("*").alias("samples"), F.sum(d * d).alias("sse"))
    return out.withColumn("psnr", _psnr(F.col("sse"), F.col("samples"), bits, equal))


def plane_mse(samples: DataFrame) -> DataFrame:
    """Mean squared error of each plane, and of the whole image as plane ALL, in one pass."""
    d = F.col("v") - F.col("w")
    return samples.groupingSets([["image", "plane"], ["image"]], "image", "plane").agg((F.sum(d * d) / F.count("*")).alias("mse")).select("image", F.coalesce("plane", F.lit("ALL")).alias("plane"), "mse")


def depth_shift(samples: DataFrame, shift: int, bits: int) -> DataFrame:
    """samples at a lower bit depth: the original shifted down, the other rounded and clipped."""
    peak = (1 << (bits - shift)) - 1
    rounded = F.shiftright(F.col("w") + (1 << (shift - 1)), shift)
    return samples.withColumns({"v": F.shiftright("v", shift), "w": F.least(F.greatest(rounded, F.lit(0)), F.lit(peak))})


def sequence_psnr(frames: DataFrame, block: int = prefix.BLOCK) -> DataFrame:
    """(seq, frame, psnr) with the running mean over the frames so far; a sequence is split over tasks by blocks of frame numbers. Frames without a PSNR don't count."""
    sums = {"__sum": F.col("psnr"), "__many": F.col("psnr").isNotNull().cast("long")}
    rows = prefix.running(frames, sums, block)
    return rows.select(*frames.columns, F.try_divide(F.col("__sum"), F.col("__many")).alias("running"))


def field_merge(fields: DataFrame, height: int) -> DataFrame:
    """Lines of two fields as lines of one frame: line = 2 * row + field."""
    return fields.where(F.col("row") * 2 + F.col("field") < height).withColumn("line", F.col("row") * 2 + F.col("field"))


def field_merge_psnr(fields: DataFrame, frames: DataFrame, bits: int, height: int) -> DataFrame:
    """PSNR of each frame merged from two fields (image, field, row, x, w) against the original (image, line, x, v)."""
    both = field_merge(fields, height).join(frames, ["image", "line", "x"])
    return plane_psnr(both.withColumn("plane", F.lit("Y")), bits).select("image", "samples", "sse", "psnr")


def frame_bits(counters: DataFrame, block: int = prefix.BLOCK) -> DataFrame:
    """(seq, frame, kind, bits): the rise of a bit counter from frame to frame, across blocks of frame numbers that are tasks of their own."""
    rows = prefix.previous(counters, "counter", "__before", block)
    return rows.withColumn("bits", F.col("counter") - F.coalesce("__before", F.lit(0))).drop("__before")


def bits_by_type(counters: DataFrame, block: int = prefix.BLOCK) -> DataFrame:
    """Bits of the I, P and B frames of each sequence."""
    total = {k: F.sum(F.when(F.col("kind") == k, F.col("bits")).otherwise(0)).alias(f"{k.lower()}_bits") for k in ("I", "P", "B")}
    return frame_bits(counters, block).groupBy("seq").agg(*total.values(), F.count("*").alias("frames"))


def bitrate(counters: DataFrame, frame_rate: float, block: int = prefix.BLOCK) -> DataFrame:
    """kbit/s of each sequence, with and without its duplicate bits."""
    out = frame_bits(counters, block).groupBy("seq").agg(F.sum("bits").alias("bits"), F.sum("duplicate").alias("duplicate"), F.count("*").alias("frames"))
    rate = lambda bits: bits * frame_rate / F.col("frames") / 1000
    return out.select("seq", rate(F.col("bits")).alias("kbps"), rate(F.col("bits") - F.col("duplicate")).alias("kbps_without_duplicates"))


def frame_digest(samples: DataFrame) -> DataFrame:
    """MD5 over the samples of a frame in the order of planes Y, U, V and places; rows are sorted and folded as they come, so a frame of any size fits."""
    rows = samples.select("image", F.instr(F.lit("YUV"), F.col("plane")).alias("p"), "idx", F.col("v").cast("string").alias("v"))
    return fold_digest(rows, ["p", "idx"], lambda x: x.as_py().encode())


def hdr_to_rg(v: Column) -> tuple[Column, Column, Column]:
    """A 16-bit sample as two 8-bit planes: high byte, low byte, 0."""
    return F.shiftright(v, 8), v.bitwiseAND(255), F.lit(0)


def rg_to_hdr(r: Column, g: Column) -> Column:
    return F.shiftleft(r, 8).bitwiseOR(g)


def hdr_to_l8(v: Column) -> Column:
    """Clamped to 255."""
    return F.least(v, F.lit(255))
