"""Comparison of codecs with a baseline codec over the trial table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rdlab.plans.grid import numbered

SLICE = ["sub_sampling", "codec", "target_metric", "target_value"]


def distinct_sorted(encodes: DataFrame, *columns: str) -> DataFrame:
    """(name, seq, value): distinct values of the columns, each with its place in their order. One aggregate finds them all; their number is small."""
    long = encodes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    seen = long.select("x.name", "x.value").distinct()
    order = Window.partitionBy("name").orderBy(F.when(F.col("name") == "target_value", F.col("value").try_cast("double")), "value")
    return seen.select("name", F.row_number().over(order).alias("seq"), "value")


def distinct_ranked(encodes: DataFrame, column: str) -> DataFrame:
    """(name, seq, value) of one column with any number of distinct values: they are numbered over range partitions, not in one task. Nulls are left out."""
    values = encodes.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return numbered(values, "value", "at").select(F.lit(column).alias("name"), (F.col("at") + 1).cast("int").alias("seq"), "value")


def codecs_in_subsampling(encodes: DataFrame) -> DataFrame:
    """Distinct (sub_sampling, codec)."""
    return encodes.select("sub_sampling", "codec").distinct()


def size_check(encodes: DataFrame) -> DataFrame:
    """One row: the number of sizes, whether all have as many pixels, and that number (else null)."""
    sizes = encodes.select("width", "height").distinct().select((F.col("width") * F.col("height")).cast("long").alias("pixels"))
    same = F.min("pixels") == F.max("pixels")
    return sizes.agg(F.count("*").alias("sizes"), same.alias("same"), F.when(same, F.min("pixels")).alias("total_pixels"))


def metric_check(encodes: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, present): whether each asked metric is a stored target metric."""
    asked = encodes.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    stored = encodes.select(F.col("target_metric").alias("metric")).distinct().withColumn("present", F.lit(True))
    return asked.join(stored, "metric", "left").select("metric", F.coalesce("present", F.lit(False)).alias("present"))


def slice_of(encodes: DataFrame, codec: str, sub_sampling: str, target_metric: str, target_value: float) -> DataFrame:
    """The trials of one slice: metric value, bytes, VMAF, source, compression ratio, bits per pixel. All four predicates reach the scan."""
    rows = encodes.where((F.col("codec") == codec) & (F.col("sub_sampling") == sub_sampling) & (F.col("target_metric") == target_metric) & (F.col("target_value") == target_value))
    return rows.select(F.col(target_metric).alias("metric_value"), "file_size_bytes", "vmaf", "source", "compress_rate", "bpp")


def metric_value(metrics: tuple[str, ...] = ("psnr_avg", "ssim", "vmaf")) -> Column:
    """The value of a trial's own target metric."""
    out = F.when(F.col("target_metric") == "file_size_bytes", F.col("file_size_bytes"))
    for m in metrics:
        out = out.when(F.col("target_metric") == m, F.col(m))
    return out


def slice_columns(encodes: DataFrame) -> DataFrame:
    """Each slice as aligned arrays in the order of its sources."""
    names = ["metric_value", "file_size_bytes", "vmaf", "source", "compress_rate", "bpp"]
    rows = encodes.withColumn("metric_value", metric_value())
    packed = rows.groupBy(*SLICE).agg(F.array_sort(F.collect_list(F.struct(F.col("source").alias("key"), *names))).alias("x"))
    return packed.select(*SLICE, *[F.col(f"x.{c}").alias(f"{c}s") for c in names])


def slice_blocks(encodes: DataFrame, size: int = 10_000) -> DataFrame:
    """The columns of slice_columns in blocks of about `size` rows, for slices of any length: (slice keys, block, arrays in the order of sources).

    Blocks of a slice follow each other in the order of sources, from 0. Rows are ranged by slice and source and numbered in their partition, so no task holds a slice.
    """
    names = ["metric_value", "file_size_bytes", "vmaf", "source", "compress_rate", "bpp"]
    rows = encodes.withColumn("metric_value", metric_value()).select(*SLICE, *names)
    rows = numbered(rows, [*SLICE, "source"], "__at")
    rows = rows.withColumn("__block", F.floor(F.col("__at") / size).cast("long"))
    packed = rows.groupBy(*SLICE, "__block").agg(F.array_sort(F.collect_list(F.struct(F.col("source").alias("key"), *names))).alias("x"))
    nth = F.row_number().over(Window.partitionBy(*SLICE).orderBy("__block")) - 1
    return packed.select(*SLICE, nth.alias("block"), *[F.col(f"x.{c}").alias(f"{c}s") for c in names])


def slice_means(encodes: DataFrame) -> DataFrame:
    """Means of all slices in one aggregate: metric, bytes, count, VMAF, and the mean of the ratios."""
    return encodes.withColumn("metric_value", metric_value()).groupBy(*SLICE).agg(
        F.avg("metric_value").alias("mean_metric"), F.avg("file_size_bytes").alias("mean_bytes"), F.count("*").alias("images"), F.avg("vmaf").alias("mean_vmaf"), F.avg("compress_rate").alias("mean_compress_rate")
    )


def avg_reduction(means: DataFrame, baseline: str = "jpeg") -> DataFrame:
    """Percent by which a slice's mean bytes differ from the baseline's; negative means smaller."""
    keys = ["sub_sampling", "target_metric", "target_value"]
    base = means.where(F.col("codec") == baseline).select(*keys, F.col("mean_bytes").alias("base_bytes"))
    return means.join(base, keys).select(*SLICE, "images", "mean_metric", "mean_vmaf", "mean_compress_rate", ((F.col("mean_bytes") - F.col("base_bytes")) / F.col("base_bytes") * 100).alias("reduction"))


def image_reduction(encodes: DataFrame, baseline: str = "jpeg") -> DataFrame:
    """The same for each source, with its compression ratio. One shuffle: the baseline's bytes (the largest, if it has several trials) come by a window.

    Trials without a baseline trial, or with a null in the keys, are left out.
    """
    keys = ["sub_sampling", "target_metric", "target_value", "source"]
    base = F.max(F.when(F.col("codec") == baseline, F.col("file_size_bytes"))).over(Window.partitionBy(*keys))
    rows = encodes.select(*SLICE, "source", "file_size_bytes", "compress_rate").dropna(subset=keys).withColumn("base", base).where("base is not null")
    return rows.select(*SLICE, "source", "compress_rate", ((F.col("file_size_bytes") - F.col("base")) / F.col("base") * 100).alias("reduction"))


def source_alignment(encodes: DataFrame, baseline: str = "jpeg") -> DataFrame:
    """Sources that a slice has and the baseline's lacks, or the reverse; no rows if all slices are aligned."""
    keys = ["sub_sampling", "target_metric", "target_value"]
    have = encodes.select(*SLICE, "source").distinct()
    base = have.where(F.col("codec") == baseline).drop("codec")
    codecs = have.select(*SLICE).distinct()
    wanted = base.join(codecs, keys).select(*SLICE, "source").withColumn("in_baseline", F.lit(True))
    both = have.withColumn("in_codec", F.lit(True)).join(wanted, [*SLICE, "source"], "full_outer")
    return both.select(*SLICE, "source", F.coalesce("in_codec", F.lit(False)).alias("in_codec"), F.coalesce("in_baseline", F.lit(False)).alias("in_baseline")).where("in_codec <> in_baseline")


def extrema(images: DataFrame) -> DataFrame:
    """Largest and smallest over the images, per slice, of the reduction (kind terse) and the ratio (kind cr).

    For reductions the two labels are swapped: the largest saving is the smallest number.
    """
    rows = images.groupBy(*SLICE).agg(F.min("reduction").alias("r0"), F.max("reduction").alias("r1"), F.max("compress_rate").alias("c0"), F.min("compress_rate").alias("c1"))
    return rows.select(*SLICE, F.explode(F.array(F.struct(F.lit("terse").alias("kind"), F.col("r0").alias("max"), F.col("r1").alias("min")), F.struct(F.lit("cr").alias("kind"), F.col("c0").alias("max"), F.col("c1").alias("min")))).alias("x")).select(*SLICE, "x.*")


def extreme_images(images: DataFrame) -> DataFrame:
    """The source behind each slice's largest and smallest reduction; ties to the smallest name."""
    low, high = F.min(F.struct("reduction", "source")), F.min(F.struct((-F.col("reduction")).alias("n"), "source"))
    return images.groupBy(*SLICE).agg(low.alias("lo"), high.alias("hi")).select(*SLICE, F.col("lo.source").alias("best_source"), F.col("lo.reduction").alias("best"), F.col("hi.source").alias("worst_source"), (-F.col("hi.n")).alias("worst"))


def rd_series(means: DataFrame, total_pixels: float) -> DataFrame:
    """Points of each codec over the targets in order: seq, bits per pixel of the mean bytes, mean quality."""
    order = Window.partitionBy("sub_sampling", "codec", "target_metric").orderBy("target_value")
    return means.select("sub_sampling", "codec", "target_metric", F.row_number().over(order).alias("seq"), (F.col("mean_bytes") * 8 / total_pixels).alias("bpp"), F.col("mean_metric").alias("quality"))


def rd_series_filter(series: DataFrame, baseline: str = "jpeg") -> DataFrame:
    """The series worth plotting: the codec's name isn't part of the baseline's, and its first quality is finite."""
    first = F.first("quality").over(Window.partitionBy("sub_sampling", "codec", "target_metric").orderBy("seq"))
    return series.withColumn("first", first).where((F.instr(F.lit(baseline), F.col("codec")) == 0) & (F.col("first") < float("inf"))).drop("first")


def report_matrix(images: DataFrame, means: DataFrame, codecs: list[str]) -> DataFrame:
    """One row per (sub_sampling, target_value, row), one column per codec: row is a source, or avg, max, min."""
    keys = ["sub_sampling", "target_value", "codec"]
    rows = images.select(*keys, F.col("source").alias("row"), "reduction")
    rows = rows.union(means.select(*keys, F.lit("avg"), "reduction"))
    ends = extrema(images).where("kind = 'terse'")
    rows = rows.union(ends.select(*keys, F.explode(F.array(F.struct(F.lit("max").alias("row"), F.col("max").alias("v")), F.struct(F.lit("min").alias("row"), F.col("min").alias("v")))).alias("x")).select(*keys, "x.row", "x.v"))
    return rows.groupBy("sub_sampling", "target_value", "row").pivot("codec", codecs).agg(F.first("reduction"))
