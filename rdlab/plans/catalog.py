"""Codec catalog, defaults and the rules that hang on a codec's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "media string, depth int, mode string, name string, inverse boolean, param_start double, param_end double, ab_tol double, subsampling string"

#: Medium, depth, mode, codec, whether a higher parameter means lower quality, its range, the search's end width, subsampling.
CATALOG = [
    ("image", 8, "lossy", "jpeg", False, 1.0, 100.0, 0.5, "420"),
    ("image", 8, "lossy", "jpeg", False, 1.0, 100.0, 0.5, "444"),
    ("image", 8, "lossy", "jpeg-mse", False, 1.0, 100.0, 0.5, "420"),
    ("image", 8, "lossy", "jpeg-mse", False, 1.0, 100.0, 0.5, "444"),
    ("image", 8, "lossy", "jpeg-ms-ssim", False, 1.0, 100.0, 0.5, "420"),
    ("image", 8, "lossy", "jpeg-ms-ssim", False, 1.0, 100.0, 0.5, "444"),
    ("image", 8, "lossy", "jpeg-im", False, 1.0, 100.0, 0.5, "420"),
    ("image", 8, "lossy", "jpeg-im", False, 1.0, 100.0, 0.5, "444"),
    ("image", 8, "lossy", "jpeg-hvs-psnr", False, 1.0, 100.0, 0.5, "420"),
    ("image", 8, "lossy", "jpeg-hvs-psnr", False, 1.0, 100.0, 0.5, "444"),
    ("image", 8, "lossy", "kakadu-mse", False, 0.01, 3.0, 0.01, "420"),
    ("image", 8, "lossy", "kakadu-mse", False, 0.01, 3.0, 0.01, "444"),
    ("image", 8, "lossy", "kakadu-visual", False, 0.01, 3.0, 0.01, "420"),
    ("image", 8, "lossy", "kakadu-visual", False, 0.01, 3.0, 0.01, "444"),
    ("image", 8, "lossy", "openjpeg", False, 10.0, 80.0, 0.05, "420"),
    ("image", 8, "lossy", "openjpeg", False, 10.0, 80.0, 0.05, "444"),
    ("image", 8, "lossy", "flif", False, 0.0, 100.0, 0.02, "420"),
    ("image", 8, "lossy", "flif", False, 0.0, 100.0, 0.02, "444"),
    ("image", 8, "lossy", "webp", False, 0.0, 100.0, 0.001, "420"),
    ("image", 8, "lossy", "bpg", True, 0.0, 51.0, 0.01, "420"),
    ("image", 8, "lossy", "bpg", True, 0.0, 51.0, 0.01, "444"),
    ("image", 8, "lossy", "hevc", True, 10.0, 51.0, 1.0, "420"),
    ("image", 8, "lossy", "hevc", True, 10.0, 51.0, 1.0, "444"),
    ("image", 8, "lossy", "avif-mse", True, 1.0, 63.0, 1.0, "420"),
    ("image", 8, "lossy", "avif-mse", True, 1.0, 63.0, 1.0, "444"),
    ("image", 8, "lossy", "avif-ssim", True, 1.0, 63.0, 1.0, "420"),
    ("image", 8, "lossy", "avif-ssim", True, 1.0, 63.0, 1.0, "444"),
    ("image", 8, "lossy", "avifenc-sp-0", True, 1.0, 62.0, 1.0, "420"),
    ("image", 8, "lossy", "avifenc-sp-0", True, 1.0, 62.0, 1.0, "444"),
    ("image", 8, "lossy", "avifenc-sp-2", True, 1.0, 62.0, 1.0, "420"),
    ("image", 8, "lossy", "avifenc-sp-2", True, 1.0, 62.0, 1.0, "444"),
    ("image", 8, "lossy", "avifenc-sp-4", True, 1.0, 62.0, 1.0, "420"),
    ("image", 8, "lossy", "avifenc-sp-4", True, 1.0, 62.0, 1.0, "444"),
    ("image", 8, "lossy", "avifenc-sp-8", True, 1.0, 62.0, 1.0, "420"),
    ("image", 8, "lossy", "avifenc-sp-8", True, 1.0, 62.0, 1.0, "444"),
    ("image", 8, "lossless", "jpeg", True, 0.0, 0.0, 0.0, "420"),
    ("image", 8, "lossless", "jpeg", True, 0.0, 0.0, 0.0, "444"),
    ("image", 8, "lossless", "kakadu-mse", True, 0.0, 0.0, 0.0, "420"),
    ("image", 8, "lossless", "kakadu-mse", True, 0.0, 0.0, 0.0, "444"),
    ("image", 8, "lossless", "openjpeg", True, 0.0, 0.0, 0.0, "420"),
    ("image", 8, "lossless", "openjpeg", True, 0.0, 0.0, 0.0, "444"),
    ("image", 8, "lossless", "flif", True, 0.0, 0.0, 0.0, "420"),
    ("image", 8, "lossless", "flif", True, 0.0, 0.0, 0.0, "444"),
    ("image", 8, "lossless", "webp", True, 0.0, 0.0, 0.0, "420"),
    ("image", 8, "lossless", "bpg", True, 0.0, 0.0, 0.0, "420"),
    ("image", 8, "lossless", "bpg", True, 0.0, 0.0, 0.0, "444"),
    ("image", 8, "lossless", "hevc", True, 0.0, 0.0, 0.0, "420"),
    ("image", 8, "lossless", "hevc", True, 0.0, 0.0, 0.0, "444"),
    ("image", 8, "lossless", "avif-mse", True, 0.0, 0.0, 0.0, "420"),
    ("image", 8, "lossless", "avif-mse", True, 0.0, 0.0, 0.0, "444"),
    ("image", 8, "lossless", "avifenc-sp-0", True, 0.0, 0.0, 0.0, "420"),
    ("image", 8, "lossless", "avifenc-sp-0", True, 0.0, 0.0, 0.0, "444"),
    ("image", 16, "lossy", "jpeg-ms-ssim", False, 1.0, 100.0, 0.5, "420"),
    ("image", 16, "lossy", "jpeg-ms-ssim", False, 1.0, 100.0, 0.5, "444"),
    ("image", 16, "lossy", "kakadu-visual", False, 0.01, 16.0, 0.01, "420"),
    ("image", 16, "lossy", "kakadu-visual", False, 0.01, 16.0, 0.01, "444"),
    ("image", 16, "lossy", "openjpeg", False, 10.0, 200.0, 0.05, "420"),
    ("image", 16, "lossy", "openjpeg", False, 10.0, 160.0, 0.05, "444"),
    ("image", 16, "lossy", "flif", False, 0.0, 100.0, 0.02, "420"),
    ("image", 16, "lossy", "flif", False, 0.0, 100.0, 0.02, "444"),
    ("image", 16, "lossy", "hevc", True, 0.0, 51.0, 0.2, "420"),
    ("image", 16, "lossy", "hevc", True, 0.0, 51.0, 0.2, "444"),
    ("image", 16, "lossless", "jpeg", True, 0.0, 0.0, 0.0, "420"),
    ("image", 16, "lossless", "jpeg", True, 0.0, 0.0, 0.0, "444"),
    ("image", 16, "lossless", "kakadu-visual", True, 0.0, 0.0, 0.0, "420"),
    ("image", 16, "lossless", "kakadu-visual", True, 0.0, 0.0, 0.0, "444"),
    ("image", 16, "lossless", "openjpeg", True, 0.0, 0.0, 0.0, "420"),
    ("image", 16, "lossless", "openjpeg", True, 0.0, 0.0, 0.0, "444"),
    ("image", 16, "lossless", "flif", True, 0.0, 0.0, 0.0, "420"),
    ("image", 16, "lossless", "flif", True, 0.0, 0.0, 0.0, "444"),
    ("image", 16, "lossless", "hevc", True, 0.0, 0.0, 0.0, "420"),
    ("image", 16, "lossless", "hevc", True, 0.0, 0.0, 0.0, "444"),
    ("video", 8, "lossy", "avc", True, 0.0, 81.0, 0.5, "420"),
    ("video", 8, "lossy", "avc", True, 0.0, 81.0, 0.5, "444"),
    ("video", 8, "lossy", "hevc", True, 0.0, 51.0, 0.5, "420"),
    ("video", 8, "lossy", "hevc", True, 0.0, 51.0, 0.5, "444"),
    ("video", 8, "lossy", "vvc", True, 0.0, 51.0, 0.5, "420"),
    ("video", 8, "lossy", "vvc", True, 0.0, 51.0, 0.5, "444"),
    ("video", 8, "lossy", "avs3", True, 0.0, 63.0, 1.0, "420"),
    ("video", 8, "lossy", "aom-ssim", True, 1.0, 63.0, 1.0, "420"),
    ("video", 8, "lossy", "aom-ssim", True, 1.0, 63.0, 1.0, "444"),
    ("video", 8, "lossy", "rav1e-Psychovisual", True, 0.0, 255.0, 1.0, "420"),
    ("video", 8, "lossy", "rav1e-Psychovisual", True, 0.0, 255.0, 1.0, "444"),
    ("video", 8, "lossy", "svt-av1", True, 0.0, 63.0, 0.5, "420"),
    ("video", 8, "lossy", "vp8-psnr", True, 4.0, 59.0, 0.5, "420"),
    ("video", 8, "lossy", "vp8-ssim", True, 4.0, 59.0, 0.5, "420"),
    ("video", 8, "lossy", "vp9-ssim", True, 4.0, 59.0, 0.5, "420"),
    ("video", 8, "lossy", "vp9-ssim", True, 4.0, 59.0, 0.5, "444"),
    ("video", 8, "lossy", "svt-vp9-PSNR-SSIM", True, 0.0, 63.0, 0.5, "420"),
    ("video", 8, "lossy", "svt-vp9-VMAF", True, 0.0, 63.0, 0.5, "420"),
    ("video", 8, "lossless", "avc", True, 0.0, 81.0, 0.5, "420"),
    ("video", 8, "lossless", "avc", True, 0.0, 81.0, 0.5, "444"),
    ("video", 8, "lossless", "hevc", True, 0.0, 51.0, 0.5, "420"),
    ("video", 8, "lossless", "hevc", True, 0.0, 51.0, 0.5, "444"),
    ("video", 8, "lossless", "vvc", True, 0.0, 51.0, 0.5, "420"),
    ("video", 8, "lossless", "vvc", True, 0.0, 51.0, 0.5, "444"),
    ("video", 8, "lossless", "aom-ssim", True, 1.0, 63.0, 1.0, "420"),
    ("video", 8, "lossless", "aom-ssim", True, 1.0, 63.0, 1.0, "444"),
    ("video", 8, "lossless", "vp9-ssim", True, 4.0, 59.0, 0.5, "420"),
    ("video", 8, "lossless", "vp9-ssim", True, 4.0, 59.0, 0.5, "444"),
]

#: Medium, depth, mode, codec and subsampling that are accepted.
SUPPORT = [
    ("image", 8, "lossy", "jpeg", "420"),
    ("image", 8, "lossy", "jpeg", "444"),
    ("image", 8, "lossy", "jpeg-mse", "420"),
    ("image", 8, "lossy", "jpeg-mse", "444"),
    ("image", 8, "lossy", "jpeg-ms-ssim", "420"),
    ("image", 8, "lossy", "jpeg-ms-ssim", "444"),
    ("image", 8, "lossy", "jpeg-im", "420"),
    ("image", 8, "lossy", "jpeg-im", "444"),
    ("image", 8, "lossy", "jpeg-hvs-psnr", "420"),
    ("image", 8, "lossy", "jpeg-hvs-psnr", "444"),
    ("image", 8, "lossy", "kakadu-mse", "420"),
    ("image", 8, "lossy", "kakadu-mse", "444"),
    ("image", 8, "lossy", "kakadu-visual", "420"),
    ("image", 8, "lossy", "kakadu-visual", "444"),
    ("image", 8, "lossy", "openjpeg", "420"),
    ("image", 8, "lossy", "openjpeg", "444"),
    ("image", 8, "lossy", "flif", "420"),
    ("image", 8, "lossy", "flif", "444"),
    ("image", 8, "lossy", "bpg", "420"),
    ("image", 8, "lossy", "bpg", "444"),
    ("image", 8, "lossy", "hevc", "420"),
    ("image", 8, "lossy", "hevc", "444"),
    ("image", 8, "lossy", "avif-mse", "420"),
    ("image", 8, "lossy", "avif-mse", "444"),
    ("image", 8, "lossy", "avif-ssim", "420"),
    ("image", 8, "lossy", "avif-ssim", "444"),
    ("image", 8, "lossy", "avifenc-sp-0", "420"),
    ("image", 8, "lossy", "avifenc-sp-0", "444"),
    ("image", 8, "lossy", "avifenc-sp-2", "420"),
    ("image", 8, "lossy", "avifenc-sp-2", "444"),
    ("image", 8, "lossy", "avifenc-sp-4", "420"),
    ("image", 8, "lossy", "avifenc-sp-4", "444"),
    ("image", 8, "lossy", "avifenc-sp-8", "420"),
    ("image", 8, "lossy", "avifenc-sp-8", "444"),
    ("image", 8, "lossy", "webp", "420"),
    ("image", 8, "lossless", "jpeg", "420"),
    ("image", 8, "lossless", "jpeg", "444"),
    ("image", 8, "lossless", "kakadu-mse", "420"),
    ("image", 8, "lossless", "kakadu-mse", "444"),
    ("image", 8, "lossless", "kakadu-visual", "420"),
    ("image", 8, "lossless", "kakadu-visual", "444"),
    ("image", 8, "lossless", "openjpeg", "420"),
    ("image", 8, "lossless", "openjpeg", "444"),
    ("image", 8, "lossless", "flif", "420"),
    ("image", 8, "lossless", "flif", "444"),
    ("image", 8, "lossless", "bpg", "420"),
    ("image", 8, "lossless", "bpg", "444"),
    ("image", 8, "lossless", "hevc", "420"),
    ("image", 8, "lossless", "hevc", "444"),
    ("image", 8, "lossless", "avif-mse", "420"),
    ("image", 8, "lossless", "avif-mse", "444"),
    ("image", 8, "lossless", "avif-ssim", "420"),
    ("image", 8, "lossless", "avif-ssim", "444"),
    ("image", 8, "lossless", "avifenc-sp-0", "420"),
    ("image", 8, "lossless", "avifenc-sp-0", "444"),
    ("image", 8, "lossless", "avifenc-sp-2", "420"),
    ("image", 8, "lossless", "avifenc-sp-2", "444"),
    ("image", 8, "lossless", "avifenc-sp-4", "420"),
    ("image", 8, "lossless", "avifenc-sp-4", "444"),
    ("image", 8, "lossless", "avifenc-sp-8", "420"),
    ("image", 8, "lossless", "avifenc-sp-8", "444"),
    ("image", 8, "lossless", "webp", "420"),
    ("image", 16, "lossy", "jpeg", "420"),
    ("image", 16, "lossy", "jpeg", "444"),
    ("image", 16, "lossy", "jpeg-mse", "420"),
    ("image", 16, "lossy", "jpeg-mse", "444"),
    ("image", 16, "lossy", "jpeg-ms-ssim", "420"),
    ("image", 16, "lossy", "jpeg-ms-ssim", "444"),
    ("image", 16, "lossy", "jpeg-im", "420"),
    ("image", 16, "lossy", "jpeg-im", "444"),
    ("image", 16, "lossy", "jpeg-hvs-psnr", "420"),
    ("image", 16, "lossy", "jpeg-hvs-psnr", "444"),
    ("image", 16, "lossy", "kakadu-mse", "420"),
    ("image", 16, "lossy", "kakadu-mse", "444"),
    ("image", 16, "lossy", "kakadu-visual", "420"),
    ("image", 16, "lossy", "kakadu-visual", "444"),
    ("image", 16, "lossy", "openjpeg", "420"),
    ("image", 16, "lossy", "openjpeg", "444"),
    ("image", 16, "lossy", "flif", "420"),
    ("image", 16, "lossy", "flif", "444"),
    ("image", 16, "lossy", "hevc", "420"),
    ("image", 16, "lossy", "hevc", "444"),
    ("image", 16, "lossless", "jpeg", "420"),
    ("image", 16, "lossless", "jpeg", "444"),
    ("image", 16, "lossless", "kakadu-mse", "420"),
    ("image", 16, "lossless", "kakadu-mse", "444"),
    ("image", 16, "lossless", "kakadu-visual", "420"),
    ("image", 16, "lossless", "kakadu-visual", "444"),
    ("image", 16, "lossless", "openjpeg", "420"),
    ("image", 16, "lossless", "openjpeg", "444"),
    ("image", 16, "lossless", "flif", "420"),
    ("image", 16, "lossless", "flif", "444"),
    ("image", 16, "lossless", "hevc", "420"),
    ("image", 16, "lossless", "hevc", "444"),
    ("video", 8, "lossy", "avc", "420"),
    ("video", 8, "lossy", "avc", "444"),
    ("video", 8, "lossy", "hevc", "420"),
    ("video", 8, "lossy", "hevc", "444"),
    ("video", 8, "lossy", "vvc", "420"),
    ("video", 8, "lossy", "vvc", "444"),
    ("video", 8, "lossy", "avs3", "420"),
    ("video", 8, "lossy", "avs3", "444"),
    ("video", 8, "lossy", "aom-mse", "420"),
    ("video", 8, "lossy", "aom-mse", "444"),
    ("video", 8, "lossy", "aom-ssim", "420"),
    ("video", 8, "lossy", "aom-ssim", "444"),
    ("video", 8, "lossy", "rav1e-Psychovisual", "420"),
    ("video", 8, "lossy", "rav1e-Psychovisual", "444"),
    ("video", 8, "lossy", "rav1e-Psnr", "420"),
    ("video", 8, "lossy", "rav1e-Psnr", "444"),
    ("video", 8, "lossy", "vp8-ssim", "420"),
    ("video", 8, "lossy", "vp8-ssim", "444"),
    ("video", 8, "lossy", "vp8-psnr", "420"),
    ("video", 8, "lossy", "vp8-psnr", "444"),
    ("video", 8, "lossy", "vp9-ssim", "420"),
    ("video", 8, "lossy", "vp9-ssim", "444"),
    ("video", 8, "lossy", "vp9-psnr", "420"),
    ("video", 8, "lossy", "vp9-psnr", "444"),
    ("video", 8, "lossy", "svt-av1", "420"),
    ("video", 8, "lossy", "svt-vp9-visually", "420"),
    ("video", 8, "lossy", "svt-vp9-PSNR-SSIM", "420"),
    ("video", 8, "lossy", "svt-vp9-VMAF", "420"),
    ("video", 8, "lossless", "avc", "420"),
    ("video", 8, "lossless", "avc", "444"),
    ("video", 8, "lossless", "hevc", "420"),
    ("video", 8, "lossless", "hevc", "444"),
    ("video", 8, "lossless", "vvc", "420"),
    ("video", 8, "lossless", "vvc", "444"),
    ("video", 8, "lossless", "aom-mse", "420"),
    ("video", 8, "lossless", "aom-mse", "444"),
    ("video", 8, "lossless", "aom-ssim", "420"),
    ("video", 8, "lossless", "aom-ssim", "444"),
    ("video", 8, "lossless", "vp9-ssim", "420"),
    ("video", 8, "lossless", "vp9-ssim", "444"),
    ("video", 8, "lossless", "vp9-psnr", "420"),
    ("video", 8, "lossless", "vp9-psnr", "444"),
]

#: Default tolerance and targets of a metric.
TOLERANCE = {"psnr_avg": 1.0, "ssim": 0.002, "vmaf": 0.2, "file_size_bytes": 200.0}
TARGETS = {"psnr_avg": (40.0,), "ssim": (0.5, 0.8, 0.95, 0.99), "vmaf": (50.0, 55.0, 60.0, 65.0, 70.0, 75.0, 80.0, 85.0, 90.0, 95.0, 99.0)}

#: The tuning code of a codec variant; null: none.
TUNING = {"jpeg-mse": 1, "jpeg-ms-ssim": 2, "jpeg-im": 3, "jpeg-hvs-psnr": 4, "svt-vp9-visually": 0, "svt-vp9-PSNR-SSIM": 1, "svt-vp9-VMAF": 2}

#: The pixel format of a depth and subsampling.
PIXEL_FORMAT = {(8, "420"): "yuvj420p", (8, "444"): "yuvj444p", (16, "420"): "yuv420p16le", (16, "444"): "yuv444p16le"}

MODES = {"auto": "lossy", "customize": "lossy", "lossless": "lossless"}


def catalog_rows() -> list[tuple]:
    return list(CATALOG)


def support_rows() -> list[tuple]:
    return list(SUPPORT)


def codec_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog_rows(), SCHEMA)


def catalog_choice(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each request (media, depth, func_choice) the catalog's rows, auto and customize from the lossy table; one row with status unsupported if there are none."""
    mode = F.when(F.col("func_choice").isin("auto", "customize"), "lossy").when(F.col("func_choice") == "lossless", "lossless")
    rows = requests.withColumn("mode", mode).join(F.broadcast(catalog), ["media", "depth", "mode"], "left")
    return rows.select("media", "depth", "func_choice", "name", "subsampling", "param_start", "param_end", "ab_tol", F.when(F.col("name").isNull(), "unsupported").otherwise("ok").alias("status"))


def target_defaults(spark: SparkSession) -> DataFrame:
    """(metric, tolerance, target): one row per default target; a metric without any has one with null."""
    return spark.createDataFrame([(m, t, x) for m, t in TOLERANCE.items() for x in TARGETS.get(m, (None,))], "metric string, tolerance double, target double")


def pixel_format(depth: Column, subsampling: Column) -> Column:
    """Null where the pair isn't supported."""
    out = F.lit(None).cast("string")
    for (d, s), name in PIXEL_FORMAT.items():
        out = F.when((depth == d) & (subsampling == s), name).otherwise(out)
    return out


def codec_family(codec: Column) -> tuple[Column, Column]:
    """(family, variant): the parts before and after the first dash; variant null without one."""
    return F.substring_index(codec, "-", 1), F.when(F.instr(codec, "-") > 0, F.substring(codec, F.instr(codec, "-") + 1, F.lit(1000)))


def last_part(codec: Column) -> Column:
    """The part behind the last dash: a speed, a tune."""
    return F.element_at(F.split(codec, "-"), -1)


def variant_tuning(codec: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, code in TUNING.items():
        out = F.when(codec == name, code).otherwise(out)
    return out


def param_normalize(codec: Column, param: Column) -> tuple[Column, Column, Column, Column]:
    """(q, q_min, q_max, layers): the parameter as a whole number, the window of quantizers around it (avifenc 1, vpx 4), and openjpeg's layers p/8, p/4, p."""
    q = param.cast("int")
    wide = F.when(codec.startswith("avifenc"), 1).when(codec.rlike("^vp[89]"), 4)
    return q, q - wide, q + wide, F.when(codec == "openjpeg", F.array(param / 8, param / 4, param))


def unsupported(grid: DataFrame, spark: SparkSession) -> DataFrame:
    """Requested (media, depth, mode, name, subsampling) that no mode function accepts."""
    table = spark.createDataFrame(support_rows(), "media string, depth int, mode string, name string, subsampling string")
    return grid.join(F.broadcast(table), ["media", "depth", "mode", "name", "subsampling"], "left_anti")
