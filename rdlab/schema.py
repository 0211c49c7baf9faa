"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = ("id", "source", "codec", "target_metric", "sub_sampling")
_INT = ("width", "height", "depth", "frames")

#: One row per trial: a source encoded with one codec and one parameter.
ENCODES = T.StructType(
    [
        T.StructField(c, T.StringType() if c in _TEXT else T.IntegerType() if c in _INT else T.DoubleType())
        for c in (
            "id", "source", "width", "height", "depth", "codec", "codec_param", "target_metric", "target_value", "vmaf", "ssim", "ms_ssim", "vif", "adm2",
            "psnr_y", "psnr_u", "psnr_v", "psnr_avg", "mse_y", "mse_u", "mse_v", "mse_avg", "sub_sampling", "file_size_bytes", "bpp", "compress_rate", "frames", "source_file_size",
        )
    ]
)

VMAF_LOG = "struct<frames:array<struct<metrics:struct<vmaf:double,vif_scale0:double,ssim:double,ms_ssim:double,adm2:double>>>>"

BD_METRICS = ("vmaf", "ssim", "ms_ssim", "vif", "psnr_y", "psnr_avg")
