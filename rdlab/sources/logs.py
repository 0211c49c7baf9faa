"""Parsers of metric logs and tool output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rdlab.functions.paths import stem
from rdlab.schema import VMAF_LOG


def read_vmaf_json(logs: DataFrame, line_col: str = "line", frame: str = "first") -> DataFrame:
    """logs with vmaf, vif, ssim, ms_ssim, adm2 of the first frame, or their means over all frames."""
    frames = F.from_json(line_col, VMAF_LOG)["frames"]
    names = {"vmaf": "vmaf", "vif": "vif_scale0", "ssim": "ssim", "ms_ssim": "ms_ssim", "adm2": "adm2"}
    if frame == "first":
        values = {k: F.get(frames, 0)["metrics"][v] for k, v in names.items()}
    else:
        total = lambda v: F.aggregate(frames, F.lit(0.0), lambda a, x: a + x["metrics"][v])
        values = {k: F.try_divide(total(v), F.size(frames)) for k, v in names.items()}
    return logs.withColumns(values).drop(line_col)


def read_vmaf_files(spark: SparkSession, path: str, pattern: str = "*.json", frame: str = "first") -> DataFrame:
    """(trial, frames, vmaf, vif, ssim, ms_ssim, adm2, reason) of the log files in a folder, pretty-printed or not, one file a trial, named by it.

    A log is read whole, as its format has no lines; a log is bounded by the frames of one trial. A file that isn't JSON, is cut off, or has no frames
    has nulls and a reason; the others have a null reason. A file of no bytes has no row, as Spark's file sources skip it; such trials show up as missing.
    """
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(_named(F.col("_metadata.file_path")).alias("trial"), F.col("value").alias("line"))
    kind = "frames array<struct<metrics:struct<vmaf:double,vif_scale0:double,ssim:double,ms_ssim:double,adm2:double>>>, broken string"
    rows = files.withColumn("__x", F.from_json("line", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    whole = F.col("__x").isNotNull() & F.col("__x.broken").isNull() & (F.size("__x.frames") > 0)
    reason = F.when(F.trim(F.regexp_replace("line", r"\s", "")) == "", "empty").when(F.col("__x").isNull() | F.col("__x.broken").isNotNull(), "not whole JSON").when(~F.coalesce(whole, F.lit(False)), "no frames")
    rows = rows.select("trial", F.when(whole, F.size("__x.frames")).alias("frames"), F.when(whole, F.col("line")).alias("line"), reason.alias("reason"))
    return read_vmaf_json(rows, "line", frame).select("trial", "frames", "vmaf", "vif", "ssim", "ms_ssim", "adm2", "reason")


def read_psnr_files(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """(trial, key, mean, frames, bad_lines): means over the lines of each log file in a folder, one file a trial, named by it.

    Files are read by lines, so a long log is split over tasks. A value that is no number doesn't count for its key; a line without any key:value
    token is bad, and a trial with bad lines only has one row with a null key.
    """
    files = spark.read.option("pathGlobFilter", pattern).text(path).select(_named(F.col("_metadata.file_path")).alias("trial"), F.col("value").alias("line"))
    lines = files.where(F.trim("line") != "")
    tokens = F.filter(F.split(F.trim("line"), r"\s+"), lambda t: F.instr(t, ":") > 0)
    pairs = lines.select("trial", F.explode_outer(F.when(F.size(tokens) > 0, tokens)).alias("token"))
    text = F.substring_index("token", ":", -1)
    value = F.when(F.lower(text) == "inf", float("inf")).otherwise(text.try_cast("double"))
    sums = pairs.groupBy("trial", F.substring_index("token", ":", 1).alias("key")).agg(F.avg(value).alias("mean"), F.count("token").alias("frames"), F.count_if(F.col("token").isNull()).alias("n"))
    bad = F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).over(Window.partitionBy("trial"))
    some = F.max(F.col("key").isNotNull()).over(Window.partitionBy("trial"))
    return sums.select("trial", "key", "mean", "frames", bad.alias("bad_lines"), some.alias("some")).where(F.col("key").isNotNull() | ~F.col("some")).drop("some")


def _named(path: Column) -> Column:
    """The stem of a file's name; paths come escaped like URIs, where + is a plus."""
    return F.try_url_decode(F.replace(stem(path), F.lit("+"), F.lit("%2B")))


def read_psnr_log(logs: DataFrame, id_col: str = "trial", line_col: str = "line") -> DataFrame:
    """(id_col, key, mean): means over a trial's lines of all key:value tokens, the frame counter too. inf stays Infinity."""
    tokens = logs.select(id_col, F.explode(F.split(line_col, " ")).alias("token")).where(F.instr("token", ":") > 0)
    pairs = tokens.select(id_col, F.substring_index("token", ":", 1).alias("key"), F.substring_index("token", ":", -1).alias("text"))
    value = F.when(F.lower("text") == "inf", float("inf")).otherwise(F.col("text").try_cast("double"))
    return pairs.groupBy(id_col, "key").agg(F.avg(value).alias("mean"))


def psnr_wide(means: DataFrame, keys: list[str], id_col: str = "trial") -> DataFrame:
    """One column per key, without the frame counter."""
    return means.where("key <> 'n'").groupBy(id_col).pivot("key", keys).agg(F.first("mean"))


def parse_identify(df: DataFrame, text_col: str) -> DataFrame:
    """df with width, height, depth and colorspace from the last line of a tool's output; warnings stand before it."""
    parts = F.split(F.element_at(F.split(F.rtrim(F.col(text_col)), "\n"), -1), ",")
    number = lambda i: F.get(parts, i).try_cast("int")
    return df.withColumns({"width": number(0), "height": number(1), "depth": number(2), "colorspace": F.get(parts, 3)})


def merge_metrics(first: DataFrame, second: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Two metric tables of the same trials as one; the second wins where both have a value."""
    both = first.alias("a").join(second.alias("b"), keys, "full_outer")
    names = [c for c in dict.fromkeys([*first.columns, *second.columns]) if c not in keys]
    pick = {c: F.coalesce(*[F.col(f"{t}.{c}") for t, df in (("b", second), ("a", first)) if c in df.columns]) for c in names}
    out = both.select(*keys, *[v.alias(c) for c, v in pick.items()])
    return out if sizes is None else out.join(sizes, keys, "left")
