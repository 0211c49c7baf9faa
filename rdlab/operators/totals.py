"""Running totals of completed trials, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["codec", "sub_sampling", "target_metric", "target_value"]


def total_bytes(done: DataFrame) -> DataFrame:
    return done.where("status = 'ok'").groupBy(*KEYS).agg(F.sum("bytes").alias("total_bytes"))


def total_metric(done: DataFrame, metrics: tuple[str, ...] = ("vmaf", "ssim")) -> DataFrame:
    """Sum of each trial's own target metric."""
    value = F.element_at(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))]), F.col("target_metric"))
    return done.where("status = 'ok'").groupBy(*KEYS).agg(F.sum(value).alias("total_metric"))


def total_errors(done: DataFrame) -> DataFrame:
    return done.groupBy("codec", "sub_sampling").agg(F.count_if(F.col("status") == "error").alias("errors"))


def totals(done: DataFrame, metrics: tuple[str, ...] = ("vmaf", "ssim")) -> DataFrame:
    """Bytes, metric and errors of each key in one aggregate; it serves batches and streams."""
    value = F.element_at(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))]), F.col("target_metric"))
    ok = F.col("status") == "ok"
    return done.groupBy(*KEYS).agg(F.sum(F.when(ok, F.col("bytes")).otherwise(0)).alias("total_bytes"), F.sum(F.when(ok, value).otherwise(0.0)).alias("total_metric"), F.count_if(F.col("status") == "error").alias("errors"))


def payload_report(catalog: DataFrame, sums: DataFrame) -> DataFrame:
    """kB of each catalog row and target; 0 where nothing came."""
    got = sums.select(*KEYS, "total_bytes")
    return catalog.join(got, KEYS, "left").select(*KEYS, (F.coalesce("total_bytes", F.lit(0)) / 1000.0).alias("payload_kb"))


def payload_lossless(done: DataFrame) -> DataFrame:
    """kB of each codec and subsampling over all its targets, as lossless trials have none; 0 where every trial failed."""
    return done.groupBy("codec", "sub_sampling").agg((F.sum(F.when(F.col("status") == "ok", F.col("bytes")).otherwise(0)) / 1000.0).alias("payload_kb"))


def metric_over_images(catalog: DataFrame, sums: DataFrame, errors: DataFrame, images: DataFrame, video: bool = False) -> DataFrame:
    """The metric's sum over the number of all images; the video form divides by it only where there were errors, else by 1."""
    n = F.broadcast(images.agg(F.count("*").alias("images")))
    rows = catalog.join(sums.select(*KEYS, "total_metric"), KEYS, "left").join(errors, ["codec", "sub_sampling"], "left").crossJoin(n)
    by = F.when(F.coalesce("errors", F.lit(0)) > 0, F.col("images")).otherwise(1) if video else F.col("images")
    return rows.select(*KEYS, F.try_divide(F.coalesce("total_metric", F.lit(0.0)), by).alias("metric"), F.coalesce("errors", F.lit(0)).alias("errors"))


def metrics_over_images(done: DataFrame, images: DataFrame, metrics: tuple[str, ...] = ("vmaf", "ssim")) -> DataFrame:
    """(keys, image_metric, video_metric, errors): both forms of metric_over_images from one scan of the completions; errors are those of the codec and subsampling."""
    sums = totals(done, metrics)
    errors = F.sum("errors").over(Window.partitionBy("codec", "sub_sampling"))
    rows = sums.select(*KEYS, "total_metric", errors.alias("errors")).crossJoin(F.broadcast(images.agg(F.count("*").alias("images"))))
    by = F.when(F.col("errors") > 0, F.col("images")).otherwise(1)
    return rows.select(*KEYS, F.try_divide("total_metric", F.col("images")).alias("image_metric"), F.try_divide("total_metric", by).alias("video_metric"), "errors")
