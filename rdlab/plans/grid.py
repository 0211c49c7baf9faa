"""Planning of trials: grids, sweeps, names, batches, and what is still missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rdlab.functions.paths import extension, stem
from rdlab.sources.scratch import written

MAX_ID = 255


def trial_grid(images: DataFrame, catalog: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Every image with every codec row, and with every target if given (customize); else target 0 of psnr_avg.

    Catalog and targets are code tables of a few hundred rows, so each image is repeated in place and the grid is never shuffled. The images are, before
    they are repeated: a table of them is small against the grid, and the few tasks that scan it would make all of the grid.
    """
    images = images.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    codecs = F.broadcast(catalog.select(F.col("name").alias("codec"), "inverse", "param_start", "param_end", "ab_tol", F.col("subsampling").alias("sub_sampling")))
    grid = images.crossJoin(codecs)
    if targets is None:
        return grid.withColumns({"target_metric": F.lit("psnr_avg"), "target_value": F.lit(0.0)})
    return grid.crossJoin(F.broadcast(targets.select(F.col("metric").alias("target_metric"), F.col("target").alias("target_value"))))


def param_sweep(catalog: DataFrame, steps: int) -> DataFrame:
    """`steps` evenly spaced parameters of each codec row, both ends included."""
    rows = catalog.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    return rows.withColumn("param", F.col("param_start") + F.col("step") * (F.col("param_end") - F.col("param_start")) / max(1, steps - 1))


def image_part(path: Column, size: list[Column]) -> Column:
    """{stem}_{ext}_{w}x{h}[x{frames}]: the part of a trial's id that all trials of an image share; it takes patterns, so it is best made before the grid."""
    return F.concat_ws("_", stem(path), F.substring(extension(path), 2, 1000), F.concat_ws("x", *[s.cast("string") for s in size]))


def trial_id(image: Column, codec: Column, metric: Column, target: Column, sub: Column, param: Column) -> Column:
    """{image}_{codec}_{metric}_{target}_{sub}_{param}_ from image_part"""
    return F.concat_ws("_", image, codec, metric, target.cast("string"), sub, param.cast("string"), F.lit(""))


def id_status(name: Column) -> Column:
    return F.when(F.length(name) > MAX_ID, "too_long").otherwise("ok")


def missing_trials(grid: DataFrame, encodes: DataFrame) -> DataFrame:
    """Trials whose id isn't stored."""
    return grid.join(encodes.select("id"), "id", "left_anti")


def duplicate_ids(encodes: DataFrame) -> DataFrame:
    return encodes.groupBy("id").agg(F.count("*").alias("stored")).where("stored > 1")


def numbered(df: DataFrame, order: str | list[str], name: str = "number") -> DataFrame:
    """df with its rows numbered from 0 in the order of a column or several, without one task for all rows; equal rows in any order.

    A range partitioning sorts; each partition's count gives the offset of the next. Only these offsets, a row for each partition, are broadcast.
    """
    order = [order] if isinstance(order, str) else order
    parts = df.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33))
    parts = written(parts, "numbered")  # the places that were counted are the ones that are read
    counts = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = F.broadcast(counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("__before")))
    return parts.join(offsets, "__part").select(*df.columns, (F.col("__before") + F.col("__at")).alias(name))


def frame_batches(frames: DataFrame, step: int, path_col: str = "path") -> DataFrame:
    """Frames in the order of their paths, numbered, in batches of `step`, with new names YUV_%04d/IMG_%04d.ext."""
    rows = numbered(frames, path_col, "frame_no").withColumn("batch_id", F.floor(F.col("frame_no") / step).cast("long"))
    return rows.withColumn("new_name", F.concat(F.format_string("YUV_%04d/IMG_%04d", "batch_id", "frame_no"), extension(F.col(path_col))))


def batch_frames(batches: DataFrame) -> DataFrame:
    """The real number of frames of each batch."""
    return batches.groupBy("batch_id").agg(F.count("*").alias("frames"))


def uniform_dims(images: DataFrame, width: int, height: int, depth: int) -> DataFrame:
    """Images with status ok, or mismatch where size or depth differ."""
    same = (F.col("width") == width) & (F.col("height") == height) & (F.col("depth") == depth)
    return images.withColumn("status", F.when(same, "ok").otherwise("mismatch"))


def depth_colorspace_filter(images: DataFrame, depth: int, colorspace: str) -> DataFrame:
    return images.where((F.col("depth") == depth) & (F.col("colorspace") == colorspace))


def trial_modes(grid: DataFrame, mode: str) -> DataFrame:
    """Tag trials with their mode and first parameter: customize the middle of the range, lossless 0, auto the sweep's."""
    if mode == "auto":
        param = F.col("param").cast("double")
    else:
        param = F.lit(0.0) if mode == "lossless" else (F.col("param_start") + F.col("param_end")) / 2
    return grid.withColumn("mode", F.lit(mode)).withColumn("first_param", param)


def all_modes(grid: DataFrame) -> DataFrame:
    """Each trial once for every mode, from one grid: as trial_modes for auto, customize and lossless together."""
    first = {"auto": F.col("param").cast("double"), "customize": (F.col("param_start") + F.col("param_end")) / 2, "lossless": F.lit(0.0)}
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), p.alias("first_param")) for m, p in first.items()])).alias("__m")
    return grid.select("*", modes).select(*[F.col(f"`{c}`") for c in grid.columns], "__m.mode", "__m.first_param")
