"""Trial, image, sample and log tables derived from the given tables, in SQL that more than one engine reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ENCODES = """
WITH cells AS (
  SELECT l_suppkey AS sk, l_partkey % 7 AS cx, l_linestatus AS ls, CAST(round(l_discount * 100) AS BIGINT) AS lvl,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM {lineitem} GROUP BY l_suppkey, l_partkey % 7, l_linestatus, CAST(round(l_discount * 100) AS BIGINT)),
grid AS (
  SELECT s_suppkey AS sk, cx, codec, ls, sub_sampling, lvl FROM {supplier}
  CROSS JOIN (VALUES (0, 'jpeg'), (1, 'webp'), (2, 'openjpeg'), (3, 'bpg'), (4, 'hevc'), (5, 'avif-mse'), (6, 'kakadu-mse')) AS c(cx, codec)
  CROSS JOIN (VALUES ('F', '420'), ('O', '444')) AS u(ls, sub_sampling)
  CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) AS l(lvl)
  WHERE NOT (codec = 'webp' AND sub_sampling = '444') AND NOT (s_suppkey % 25 = 24 AND codec = 'bpg' AND lvl = 3)),
v AS (
  SELECT g.*, coalesce(q, 0) AS q, coalesce(cents, 0) AS cents FROM grid g
  LEFT JOIN cells c ON g.sk = c.sk AND g.cx = c.cx AND g.ls = c.ls AND g.lvl = c.lvl),
m AS (
  SELECT *, (6000000 + 350000 * lvl + cents % 349999) / 100000e0 AS vmaf, (8000000 + 180000 * lvl + (q * 31) % 179999) / 10000000e0 AS ssim,
    (8500000 + 140000 * lvl + (q * 17) % 139999) / 10000000e0 AS ms_ssim, (4000000 + 500000 * lvl + (cents * 7) % 499999) / 10000000e0 AS vif,
    (8100000 + 170000 * lvl + (q * 13) % 169999) / 10000000e0 AS adm2, (2900 + 110 * lvl + q % 113) / 100e0 AS psnr_y,
    (2800 + 115 * lvl + cents % 121 + CASE WHEN sk % 50 = 49 AND cx = 6 THEN 4000 ELSE 0 END) / 100e0 AS psnr_avg,
    CAST(floor((6000 + 1500 * lvl + 250 * lvl * lvl) * (110 - 7 * cx) / 100e0) AS DOUBLE) + q % 97 AS file_size_bytes
  FROM v)
SELECT concat('IMG_', lpad(CAST(sk AS STRING), CAST(greatest(4, length(CAST(sk AS STRING))) AS INT), '0'), '_png_768x512_', codec, '_psnr_avg_', CAST(CAST(20 + 5 * lvl AS DOUBLE) AS STRING), '_', sub_sampling, '_0_') AS id,
  concat('IMG_', lpad(CAST(sk AS STRING), CAST(greatest(4, length(CAST(sk AS STRING))) AS INT), '0'), '.png') AS source, 768 AS width, 512 AS height, 8 AS depth, codec,
  CAST(CASE WHEN cx IN (3, 4, 5) THEN 60 - 5 * lvl ELSE 5 + 9 * lvl END AS DOUBLE) AS codec_param, 'psnr_avg' AS target_metric, CAST(20 + 5 * lvl AS DOUBLE) AS target_value,
  vmaf, ssim, ms_ssim, vif, adm2, psnr_y, psnr_y + 1.5e0 AS psnr_u, psnr_y + 2e0 AS psnr_v, psnr_avg,
  round(65025e0 / power(10e0, psnr_y / 10e0), 6) AS mse_y, round(65025e0 / power(10e0, (psnr_y + 1.5e0) / 10e0), 6) AS mse_u, round(65025e0 / power(10e0, (psnr_y + 2e0) / 10e0), 6) AS mse_v,
  round(65025e0 / power(10e0, psnr_avg / 10e0), 6) AS mse_avg, sub_sampling, file_size_bytes, file_size_bytes * 8 / 393216e0 AS bpp, 393216e0 / file_size_bytes AS compress_rate, 1 AS frames, 393216e0 AS source_file_size
FROM m
"""

IMAGES = """
SELECT concat('/img/', p_brand, '/IMG_', CAST(p_partkey AS STRING), '.png') AS path, CAST(640 + 64 * (p_size % 3) AS INT) AS width, 512 AS height,
  CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 16 ELSE 8 END AS depth, CASE WHEN p_size % 2 = 0 THEN 'Gray' ELSE 'sRGB' END AS colorspace
FROM {part}
"""

PSNR_LINES = """
SELECT user_id AS trial, concat('n:', CAST(event_id % 30 AS STRING), ' psnr_y:', CAST(30 + CAST(floor(value) AS BIGINT) % 20 AS STRING), '.', lpad(CAST(event_id % 100 AS STRING), 2, '0'),
  ' mse_y:', CAST(CAST(floor(value) AS BIGINT) % 50 AS STRING), '.00') AS line
FROM {events}
"""

VMAF_LINES = """
SELECT event_id AS trial, concat('{{"frames":[{{"metrics":{{"vmaf":', CAST(CAST(floor(value) AS BIGINT) % 100 AS STRING), ',"vif_scale0":0.', CAST(1 + event_id % 9 AS STRING), ',"ssim":0.9', CAST(event_id % 10 AS STRING),
  ',"ms_ssim":0.8', CAST(event_id % 10 AS STRING), ',"adm2":0.7', CAST(event_id % 10 AS STRING), '}}}},{{"metrics":{{"vmaf":1,"vif_scale0":1,"ssim":1,"ms_ssim":1,"adm2":1}}}}]}}') AS line
FROM {events}
"""

COMPLETIONS = """
SELECT event_id, user_id, event_type AS codec, CASE WHEN user_id % 2 = 0 THEN '420' ELSE '444' END AS sub_sampling, 'vmaf' AS target_metric, CAST(90 + 5 * (event_id % 2) AS DOUBLE) AS target_value,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CAST(round(value * 100) AS BIGINT) AS bytes, value AS vmaf, round(value / 2, 3) AS ssim
FROM {events}
"""

CTES = {"encodes": ENCODES, "images": IMAGES, "psnr_lines": PSNR_LINES, "vmaf_lines": VMAF_LINES, "completions": COMPLETIONS}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = CTES[name]
    tables = {t: read(spark, sf_dir, t) for t in re.findall(r"(?<!\{)\{(\w+)\}", text)}
    return spark.sql(text, **tables)


def sql(name: str) -> str:
    """The fixture as SQL over the given tables."""
    text = CTES[name]
    return text.format(**{t: t for t in re.findall(r"(?<!\{)\{(\w+)\}", text)})


SAMPLES = """
SELECT vec_id AS image, CASE WHEN idx < 42 THEN 'Y' WHEN idx < 53 THEN 'U' ELSE 'V' END AS plane, idx, v, CAST(floor(v / 64e0) AS BIGINT) * 64 + 32 AS w, label
FROM (SELECT vec_id, label, CAST(i - 1 AS INT) AS idx, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 32767) AS BIGINT) AS v
  FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))
"""
