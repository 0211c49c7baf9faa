"""The registered queries of the library's operators, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rdlab import fixtures
from rdlab.functions import paths
from rdlab.operators import analysis, bdrate, isolated, pixels, report, tiles, totals, trials
from rdlab.plans import catalog, grid
from rdlab.schema import BD_METRICS
from rdlab.sources import buckets, database, files, logs, raw, store
from rdlab.sources.scratch import new_path, written
from rdlab.streaming import totals as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PIXELS = 393216.0


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _with(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({fixtures.SAMPLES if n == 'samples' else fixtures.sql(n)})" for n in names)


def encodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fixture(spark, sf_dir, "encodes")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fixture(spark, sf_dir, "images")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fixture(spark, sf_dir, "completions")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), "label", F.posexplode("embedding").alias("idx", "x"))
    plane = F.when(F.col("idx") < 42, "Y").when(F.col("idx") < 53, "U").otherwise("V")
    v = F.floor((F.col("x").cast("double") + 1) * 32767).cast("long")
    return rows.select("image", plane.alias("plane"), "idx", v.alias("v"), (F.floor(v / 64).cast("long") * 64 + 32).alias("w"), "label")


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def _values(rows: list[tuple]) -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


CATALOG = f"catalog AS (SELECT * FROM {_values(catalog.catalog_rows())} AS c(media, depth, mode, name, inverse, param_start, param_end, ab_tol, subsampling))"
E_ = _with("encodes")
EC = E_ + ", " + CATALOG
SLICE = "sub_sampling, codec, target_metric, target_value"

# --- 2.1 scans, sources, sinks


@query()
def list_images(spark, sf_dir):
    return files.list_images(spark, sf_dir, "*.parquet").select(paths.file_name(F.col("path")).alias("name"), "length")


@query(_with("images") + " SELECT path, (SELECT count(DISTINCT path) FROM images)::BIGINT AS images FROM images GROUP BY path")
def image_set(spark, sf_dir):
    return files.image_set(images(spark, sf_dir))


@query(_with("images") + r" SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '([^/]*)\.[^./]*$', 1) AS stem, regexp_extract(path, '(\.[^./]*)$', 1) AS ext FROM images")
def split_path(spark, sf_dir):
    p = F.col("path")
    return images(spark, sf_dir).select("path", paths.directory(p).alias("dir"), paths.file_name(p).alias("name"), paths.stem(p).alias("stem"), paths.extension(p).alias("ext"))


@query("SELECT doc_id, strlen(text)::DOUBLE AS bytes FROM documents")
def encoded_size(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "documents").select("doc_id", files.encoded_size(F.col("text")).alias("bytes"))


@query(
    _with("vmaf_lines")
    + " SELECT trial, json_extract(line, '$.frames[0].metrics.vmaf')::DOUBLE AS vmaf, json_extract(line, '$.frames[0].metrics.vif_scale0')::DOUBLE AS vif, json_extract(line, '$.frames[0].metrics.ssim')::DOUBLE AS ssim,"
    " json_extract(line, '$.frames[0].metrics.ms_ssim')::DOUBLE AS ms_ssim, json_extract(line, '$.frames[0].metrics.adm2')::DOUBLE AS adm2 FROM vmaf_lines"
)
def read_vmaf_json(spark, sf_dir):
    return logs.read_vmaf_json(fixtures.fixture(spark, sf_dir, "vmaf_lines"))


@query(
    _with("psnr_lines")
    + " SELECT trial, split_part(token, ':', 1) AS key, round(avg(split_part(token, ':', 2)::DOUBLE), 6) AS mean FROM (SELECT trial, unnest(string_split(line, ' ')) AS token FROM psnr_lines) GROUP BY ALL"
)
def read_psnr_log(spark, sf_dir):
    return logs.read_psnr_log(fixtures.fixture(spark, sf_dir, "psnr_lines")).select("trial", "key", r6("mean").alias("mean"))


_FRAMES = [(k, v) for k, v in (("vmaf", "vmaf"), ("vif", "vif_scale0"), ("ssim", "ssim"), ("ms_ssim", "ms_ssim"), ("adm2", "adm2"))]


@query(_with("vmaf_lines") + " SELECT trial, " + ", ".join(f"round((json_extract(line, '$.frames[0].metrics.{v}')::DOUBLE + json_extract(line, '$.frames[1].metrics.{v}')::DOUBLE) / 2, 6) AS {k}" for k, v in _FRAMES) + " FROM vmaf_lines")
def read_vmaf_json_means(spark, sf_dir):
    return logs.read_vmaf_json(fixtures.fixture(spark, sf_dir, "vmaf_lines"), frame="mean").withColumns({k: r6(k) for k, _ in _FRAMES})


@query(_with("psnr_lines") + ", t AS (SELECT trial, unnest(string_split(line, ' ')) AS token FROM psnr_lines) SELECT trial, " + ", ".join(f"round(avg(CASE WHEN token LIKE '{k}:%' THEN split_part(token, ':', 2)::DOUBLE END), 6) AS {k}" for k in ("psnr_y", "mse_y")) + " FROM t GROUP BY trial")
def psnr_wide(spark, sf_dir):
    means = logs.read_psnr_log(fixtures.fixture(spark, sf_dir, "psnr_lines"))
    return logs.psnr_wide(means, ["psnr_y", "mse_y"]).withColumns({k: r6(k) for k in ("psnr_y", "mse_y")})


VMAF_FILES = """
WITH f AS (SELECT coalesce(user_id::VARCHAR, 'none') AS trial, event_id, floor(value)::BIGINT % 100 + 0e0 AS vmaf, (1 + event_id % 9) / 10e0 AS vif, (90 + event_id % 10) / 100e0 AS ssim, (80 + event_id % 10) / 100e0 AS ms_ssim, (70 + event_id % 10) / 100e0 AS adm2 FROM events)
SELECT trial, count(*)::INTEGER AS frames, arg_min(vmaf, event_id) AS vmaf, arg_min(vif, event_id) AS vif, arg_min(ssim, event_id) AS ssim, arg_min(ms_ssim, event_id) AS ms_ssim, arg_min(adm2, event_id) AS adm2, NULL::VARCHAR AS reason FROM f GROUP BY trial
"""


@query(VMAF_FILES)
def read_vmaf_files(spark, sf_dir):
    # a pretty-printed log a user, whose frames are the user's events
    path, e = new_path(spark, "vmaf"), F.col("event_id")
    metrics = F.struct((F.floor("value") % 100).cast("double").alias("vmaf"), ((1 + e % 9) / 10.0).alias("vif_scale0"), ((90 + e % 10) / 100.0).alias("ssim"), ((80 + e % 10) / 100.0).alias("ms_ssim"), ((70 + e % 10) / 100.0).alias("adm2"))
    rows = fixtures.read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(e.alias("frameNum"), metrics.alias("metrics")))).alias("frames"))
    text = F.to_json(F.struct(F.lit("2.3.1").alias("version"), "frames"), {"pretty": "true"})
    raw.write_files(rows.select(F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("none")), F.lit(".json")).alias("name"), text.alias("content")), path)
    return logs.read_vmaf_files(spark, path)


@query(
    _with("psnr_lines")
    + " SELECT trial::VARCHAR AS trial, split_part(token, ':', 1) AS key, round(avg(split_part(token, ':', 2)::DOUBLE), 6) AS mean, count(*)::BIGINT AS frames, 0::BIGINT AS bad_lines FROM (SELECT trial, unnest(string_split(line, ' ')) AS token FROM psnr_lines) GROUP BY ALL"
)
def read_psnr_files(spark, sf_dir):
    path = new_path(spark, "psnr")
    rows = fixtures.fixture(spark, sf_dir, "psnr_lines").groupBy("trial").agg(F.array_join(F.collect_list("line"), "\n").alias("content"))
    raw.write_files(rows.select(F.concat(F.col("trial").cast("string"), F.lit(".log")).alias("name"), "content"), path)
    return logs.read_psnr_files(spark, path).withColumn("mean", r6("mean"))


@query(_with("images") + " SELECT path, width, height, depth, colorspace FROM images")
def parse_identify(spark, sf_dir):
    text = F.concat(F.lit("warning: x\n"), F.concat_ws(",", "width", "height", "depth", "colorspace"))
    return logs.parse_identify(images(spark, sf_dir).select("path", text.alias("output")), "output").drop("output")


@query("SELECT doc_id, i::INTEGER AS frame_no, substr(text, i * 4096 + 1, 4096) AS frame FROM (SELECT doc_id, text, unnest(range(length(text) // 4096)) AS i FROM documents)")
def fixed_frames(spark, sf_dir):
    return files.fixed_frames(fixtures.read(spark, sf_dir, "documents"), "doc_id", "text", 4096)


@query(
    "WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)"
    " SELECT doc_id, i::BIGINT AS frame_no, substr(h, i * 1024 + 1, 1024) AS frame FROM (SELECT doc_id, h, unnest(range(length(h) // 1024)) AS i FROM d)"
)
def raw_frames(spark, sf_dir):
    # a raw file a document, read back by ranges of 8 KB, which are much smaller than the larger files
    path = new_path(spark, "raw")
    docs = fixtures.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    raw.write_files(docs, path)
    rows = raw.read_frames(spark, path, 512, range_bytes=8192, partition_bytes=1 << 20)
    return rows.select(F.col("name").cast("long").alias("doc_id"), "frame_no", F.hex("frame").alias("frame"))


@query(E_ + " SELECT * FROM encodes")
def read_encodes(spark, sf_dir):
    path = new_path(spark, "encodes")
    encodes(spark, sf_dir).write.partitionBy("sub_sampling").parquet(path)
    return store.read_encodes(spark, path)


@query(E_ + " SELECT * FROM encodes")
def read_database(spark, sf_dir):
    # SQLite files, read back in ranges smaller than a file
    path = new_path(spark, "database")
    database.write_database(encodes(spark, sf_dir), path, rows=5000)
    return database.read_database(spark, path, rows=2000)


@query(E_ + " SELECT sub_sampling, count(*)::BIGINT AS trials FROM encodes GROUP BY sub_sampling")
def create_encodes(spark, sf_dir):
    path = new_path(spark, "store")
    store.create_encodes(spark, path)
    store.insert_trials(spark, path, encodes(spark, sf_dir).withColumn("arrival", F.lit(1)))
    store.create_encodes(spark, path, resume=True)
    return store.read_encodes(spark, path).groupBy("sub_sampling").agg(F.count("*").alias("trials"))


@query(E_ + ", a AS (SELECT id, file_size_bytes, 1 AS arrival FROM encodes UNION ALL SELECT id, file_size_bytes + 1, 2 FROM encodes WHERE codec = 'hevc') SELECT id, min(arrival) AS arrival, arg_min(file_size_bytes, arrival) AS file_size_bytes FROM a WHERE id NOT IN (SELECT id FROM encodes WHERE target_value < 40) GROUP BY id")
def insert_trials(spark, sf_dir):
    rows = encodes(spark, sf_dir).select("id", "codec", "target_value", "file_size_bytes")
    arrived = rows.withColumn("arrival", F.lit(1)).union(rows.where("codec = 'hevc'").withColumns({"file_size_bytes": F.col("file_size_bytes") + 1, "arrival": F.lit(2)}))
    return store.new_trials(arrived, rows.where("target_value < 40"), "arrival").select("id", "arrival", "file_size_bytes")


@query(SQL["insert_trials"])
def insert_trials_bucketed(spark, sf_dir):
    # the store holds what was there, the arrivals are shuffled into its buckets
    rows = encodes(spark, sf_dir).select("id", "codec", "target_value", "file_size_bytes")
    path = new_path(spark, "buckets")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    stored = rows.where("target_value < 40").withColumn("arrival", F.lit(0)).select("id", "arrival", "file_size_bytes")
    buckets.create(spark, table, path, stored.schema, 16)
    buckets.insert(table, stored)
    arrived = rows.withColumn("arrival", F.lit(1)).union(rows.where("codec = 'hevc'").withColumns({"file_size_bytes": F.col("file_size_bytes") + 1, "arrival": F.lit(2)}))
    buckets.insert(table, arrived)
    return spark.table(table).where("arrival > 0").select("id", "arrival", "file_size_bytes")


@query(E_ + " SELECT id, codec, target_value FROM encodes WHERE id NOT IN (SELECT id FROM encodes WHERE file_size_bytes < 20000)")
def missing_trials_bucketed(spark, sf_dir):
    rows = encodes(spark, sf_dir)
    path = new_path(spark, "buckets")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    stored = rows.where("file_size_bytes < 20000").select("id")
    buckets.create(spark, table, path, stored.schema, 16)
    buckets.insert(table, stored.withColumn("arrival", F.lit(1)))
    return buckets.missing(rows.select("id", "codec", "target_value"), table)


def _avg_sql(baseline: str) -> str:
    return f", m AS (SELECT {SLICE}, avg(psnr_avg) AS q, avg(file_size_bytes) AS b, count(*)::BIGINT AS images, avg(vmaf) AS vmaf, avg(compress_rate) AS cr FROM encodes GROUP BY {SLICE}), r AS (SELECT m.*, (m.b - j.b) / j.b * 100 AS reduction FROM m JOIN m j ON j.codec = '{baseline}' AND j.sub_sampling = m.sub_sampling AND j.target_metric = m.target_metric AND j.target_value = m.target_value)"


AVG = E_ + _avg_sql("jpeg")
LINE = "concat(rpad(concat('T ', target_value::VARCHAR, '(', images::VARCHAR, ')'), 20, ' '), ':', lpad(concat(printf('%.2f', reduction), '%'), 15, ' '), ' ', printf('%.2f', round(q, 9))) AS line"


@query(AVG + f" SELECT {LINE} FROM r")
def report_sink(spark, sf_dir):
    path = new_path(spark, "report")
    store.report_sink(report.report_lines(analysis.avg_reduction(analysis.slice_means(encodes(spark, sf_dir)))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


RD_SERIES = E_ + f", m AS (SELECT {SLICE}, avg(psnr_avg) AS q, avg(file_size_bytes) AS b FROM encodes GROUP BY ALL), s AS (SELECT sub_sampling, codec, row_number() OVER (PARTITION BY sub_sampling, codec ORDER BY target_value)::INTEGER AS seq, round(b * 8 / 393216, 6) AS bpp, round(q, 6) AS quality FROM m)"


def _series(spark, sf_dir):
    return analysis.rd_series(analysis.slice_means(encodes(spark, sf_dir)), PIXELS)


@query(RD_SERIES + " SELECT * FROM s")
def rd_series_sink(spark, sf_dir):
    path = new_path(spark, "series")
    store.rd_series_sink(_series(spark, sf_dir), path)
    rows = spark.read.schema("codec string, target_metric string, seq int, bpp double, quality double, sub_sampling string").parquet(path)
    return rows.select("sub_sampling", "codec", "seq", r6("bpp").alias("bpp"), r6("quality").alias("quality"))


# --- 2.2 dimension tables and rules


@query(EC + " SELECT c.*, (SELECT count(*) FROM encodes e WHERE e.codec = c.name AND e.sub_sampling = c.subsampling)::BIGINT AS trials FROM catalog c")
def codec_catalog(spark, sf_dir):
    n = encodes(spark, sf_dir).groupBy(F.col("codec").alias("name"), F.col("sub_sampling").alias("subsampling")).agg(F.count("*").alias("n"))
    return catalog.codec_catalog(spark).join(n, ["name", "subsampling"], "left").withColumn("trials", F.coalesce("n", F.lit(0))).drop("n")


@query(
    _with("images") + ", " + CATALOG
    + ", r AS (SELECT media, depth, func_choice, CASE func_choice WHEN 'lossless' THEN 'lossless' WHEN 'other' THEN NULL ELSE 'lossy' END AS mode FROM (SELECT DISTINCT depth FROM images) CROSS JOIN (VALUES ('image'), ('video')) AS m(media) CROSS JOIN (VALUES ('auto'), ('customize'), ('lossless'), ('other')) AS f(func_choice))"
    " SELECT r.media, r.depth, r.func_choice, name, subsampling, param_start, param_end, ab_tol, CASE WHEN name IS NULL THEN 'unsupported' ELSE 'ok' END AS status FROM r LEFT JOIN catalog c ON r.media = c.media AND r.depth = c.depth AND r.mode = c.mode"
)
def catalog_choice(spark, sf_dir):
    asked = images(spark, sf_dir).select("depth").distinct().select("depth", F.explode(F.array(F.lit("image"), F.lit("video"))).alias("media"))
    asked = asked.select("media", "depth", F.explode(F.array(*map(F.lit, ("auto", "customize", "lossless", "other")))).alias("func_choice"))
    return catalog.catalog_choice(asked, catalog.codec_catalog(spark))


@query(
    E_ + f", t AS (SELECT * FROM {_values([(m, t, x) for m, t in catalog.TOLERANCE.items() for x in catalog.TARGETS.get(m, (None,))])} AS t(metric, tolerance, target)),"
    " v AS (SELECT unnest(['psnr_avg', 'ssim', 'vmaf']) AS metric, unnest([psnr_avg, ssim * 1, vmaf]) AS value FROM encodes)"
    " SELECT t.metric, tolerance, CAST(target AS DOUBLE) AS target, count(value)::BIGINT AS inside FROM t LEFT JOIN v ON v.metric = t.metric AND abs(value - target) < tolerance GROUP BY ALL"
)
def target_defaults(spark, sf_dir):
    long = encodes(spark, sf_dir).unpivot(["id"], ["psnr_avg", "ssim", "vmaf"], "metric", "value").alias("v")
    t = F.broadcast(catalog.target_defaults(spark)).alias("t")
    inside = long.join(t, "metric").where(F.abs(F.col("value") - F.col("target")) < F.col("tolerance")).groupBy("metric", "target").agg(F.count("*").alias("n"))
    out = catalog.target_defaults(spark).join(inside, ["metric", "target"], "left")
    return out.select("metric", "tolerance", "target", F.coalesce("n", F.lit(0)).alias("inside"))


@query(
    _with("images") + " SELECT path, depth, sub AS sub_sampling, CASE WHEN depth = 8 AND sub = '420' THEN 'yuvj420p' WHEN depth = 8 AND sub = '444' THEN 'yuvj444p' WHEN depth = 16 AND sub = '420' THEN 'yuv420p16le' WHEN depth = 16 AND sub = '444' THEN 'yuv444p16le' END AS pixel_format"
    " FROM images CROSS JOIN (VALUES ('420'), ('422'), ('444')) AS s(sub)"
)
def pixel_format(spark, sf_dir):
    rows = images(spark, sf_dir).select("path", "depth", F.explode(F.array(F.lit("420"), F.lit("422"), F.lit("444"))).alias("sub_sampling"))
    return rows.withColumn("pixel_format", catalog.pixel_format(F.col("depth"), F.col("sub_sampling")))


NAMES = EC + ", n AS (SELECT DISTINCT codec FROM encodes UNION SELECT name FROM catalog)"


def _names(spark, sf_dir):
    return encodes(spark, sf_dir).select("codec").union(catalog.codec_catalog(spark).select("name")).distinct()


@query(NAMES + " SELECT codec, split_part(codec, '-', 1) AS family, CASE WHEN strpos(codec, '-') > 0 THEN substr(codec, strpos(codec, '-') + 1) END AS variant, list_extract(string_split(codec, '-'), -1) AS last FROM n")
def codec_family(spark, sf_dir):
    family, variant = catalog.codec_family(F.col("codec"))
    return _names(spark, sf_dir).select("codec", family.alias("family"), variant.alias("variant"), catalog.last_part(F.col("codec")).alias("last"))


@query(NAMES + f", t AS (SELECT * FROM {_values(list(catalog.TUNING.items()))} AS t(codec, tuning)) SELECT n.codec, tuning::INTEGER AS tuning FROM n LEFT JOIN t ON n.codec = t.codec")
def variant_tuning(spark, sf_dir):
    return _names(spark, sf_dir).select("codec", catalog.variant_tuning(F.col("codec")).alias("tuning"))


@query(
    EC + ", p AS (SELECT name AS codec, param_end - 0.25e0 AS param, media, depth, mode, subsampling FROM catalog WHERE name IN (SELECT codec FROM encodes) OR name LIKE 'avifenc%' OR name LIKE 'vp%'), q AS (SELECT *, trunc(param)::INTEGER AS q, CASE WHEN codec LIKE 'avifenc%' THEN 1 WHEN codec LIKE 'vp8%' OR codec LIKE 'vp9%' THEN 4 END AS w FROM p)"
    " SELECT codec, media, depth, mode, subsampling, q, q - w AS q_min, q + w AS q_max, CASE WHEN codec = 'openjpeg' THEN param / 8 END AS layer0, CASE WHEN codec = 'openjpeg' THEN param / 4 END AS layer1, CASE WHEN codec = 'openjpeg' THEN param END AS layer2 FROM q"
)
def param_normalize(spark, sf_dir):
    seen = encodes(spark, sf_dir).select(F.col("codec").alias("name")).distinct().withColumn("seen", F.lit(True))
    rows = catalog.codec_catalog(spark).join(seen, "name", "left").where("seen or name like 'avifenc%' or name like 'vp%'")
    rows = rows.select(F.col("name").alias("codec"), "media", "depth", "mode", "subsampling", (F.col("param_end") - 0.25).alias("param"))
    q, lo, hi, layers = catalog.param_normalize(F.col("codec"), F.col("param"))
    return rows.select("codec", "media", "depth", "mode", "subsampling", q.alias("q"), lo.alias("q_min"), hi.alias("q_max"), *[F.get(layers, i).alias(f"layer{i}") for i in range(3)])


@query(
    E_ + f", s AS (SELECT * FROM {_values(catalog.support_rows())} AS s(media, depth, mode, name, subsampling)), g AS (SELECT media, depth, mode, name, subsampling FROM (SELECT DISTINCT codec AS name FROM encodes) CROSS JOIN (VALUES ('420'), ('444')) AS u(subsampling) CROSS JOIN (SELECT DISTINCT media, depth, mode FROM s) AS k)"
    " SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.media = g.media AND s.depth = g.depth AND s.mode = g.mode AND s.name = g.name AND s.subsampling = g.subsampling)"
)
def support_matrix(spark, sf_dir):
    kinds = F.array(*[F.struct(F.lit(m).alias("media"), F.lit(d).alias("depth"), F.lit(k).alias("mode")) for m, d, k in dict.fromkeys(r[:3] for r in catalog.SUPPORT)])
    rows = encodes(spark, sf_dir).select(F.col("codec").alias("name")).distinct().select("name", F.explode(F.array(F.lit("420"), F.lit("444"))).alias("subsampling"))
    rows = rows.select("name", "subsampling", F.explode(kinds).alias("k")).select("k.*", "name", "subsampling")
    return catalog.unsupported(rows, spark).select("media", "depth", "mode", "name", "subsampling")


# --- 2.3 planning

IC = _with("images") + ", " + CATALOG


def _lossy(spark, media: str = "image", depth: int = 8):
    return catalog.codec_catalog(spark).where(f"media = '{media}' and depth = {depth} and mode = 'lossy'")


@query(IC + " SELECT path, name AS codec, subsampling AS sub_sampling, 'psnr_avg' AS target_metric, CAST(40 AS DOUBLE) AS target_value FROM images CROSS JOIN (SELECT * FROM catalog WHERE media = 'image' AND depth = 8 AND mode = 'lossy')")
def trial_grid(spark, sf_dir):
    targets = catalog.target_defaults(spark).where("metric = 'psnr_avg'")
    return grid.trial_grid(images(spark, sf_dir), _lossy(spark), targets).select("path", "codec", "sub_sampling", "target_metric", "target_value")


@query(EC + " SELECT c.name AS codec, subsampling AS sub_sampling, i::INTEGER AS step, round(param_start + i * (param_end - param_start) / 39, 6) AS param FROM (SELECT *, unnest(range(40)) AS i FROM catalog WHERE media = 'image' AND depth = 8 AND mode = 'lossy' AND (name, subsampling) IN (SELECT codec, sub_sampling FROM encodes)) AS c")
def param_sweep(spark, sf_dir):
    used = encodes(spark, sf_dir).select(F.col("codec").alias("name"), F.col("sub_sampling").alias("subsampling")).distinct()
    rows = grid.param_sweep(_lossy(spark).join(used, ["name", "subsampling"], "left_semi"), 40)
    return rows.select(F.col("name").alias("codec"), F.col("subsampling").alias("sub_sampling"), "step", r6("param").alias("param"))


_TARGETS = _values([(m, t) for m, x in catalog.TARGETS.items() for t in x])


@query(IC + f" SELECT path, name AS codec, subsampling AS sub_sampling, metric AS target_metric, target AS target_value FROM images JOIN catalog ON media = 'image' AND mode = 'lossy' AND catalog.depth = 16 AND images.depth = 16 CROSS JOIN {_TARGETS} AS t(metric, target)")
def trial_grid_16bit(spark, sf_dir):
    """Every 16-bit image with every 16-bit codec and every default target."""
    targets = catalog.target_defaults(spark).where("target is not null")
    rows = grid.trial_grid(images(spark, sf_dir).where("depth = 16"), _lossy(spark, "image", 16), targets)
    return rows.select("path", "codec", "sub_sampling", "target_metric", "target_value")


@query(EC + " SELECT media, depth, mode, c.name AS codec, subsampling AS sub_sampling, i::INTEGER AS step, round(param_start + i * (param_end - param_start) / 4, 6) AS param FROM (SELECT *, unnest(range(5)) AS i FROM catalog WHERE name IN (SELECT codec FROM encodes)) AS c")
def param_sweep_tables(spark, sf_dir):
    """The five points of a sweep for all catalog tables: both media, both depths, lossy and lossless."""
    used = encodes(spark, sf_dir).select(F.col("codec").alias("name")).distinct()
    rows = grid.param_sweep(catalog.codec_catalog(spark).join(used, "name", "left_semi"), 5)
    return rows.select("media", "depth", "mode", F.col("name").alias("codec"), F.col("subsampling").alias("sub_sampling"), "step", r6("param").alias("param"))


_ID = "concat(regexp_extract(path, '([^/]*)\\.[^./]*$', 1), '_', regexp_extract(path, '\\.([^./]*)$', 1), '_', {size}, '_', name, '_psnr_avg_40.0_', subsampling, '_0_')"


@query(IC + f", t AS (SELECT path, name AS codec, subsampling AS sub_sampling, {_ID.format(size='width::VARCHAR, ' + chr(39) + 'x' + chr(39) + ', height::VARCHAR')} AS id FROM images CROSS JOIN catalog WHERE media = 'image' AND catalog.depth = 8 AND mode = 'lossy') SELECT *, CASE WHEN length(id) > 255 THEN 'too_long' ELSE 'ok' END AS status FROM t")
def trial_id(spark, sf_dir):
    named = images(spark, sf_dir).withColumn("image", grid.image_part(F.col("path"), [F.col("width"), F.col("height")]))
    rows = grid.trial_grid(named, _lossy(spark)).withColumn("target_value", F.lit(40.0))
    name = grid.trial_id(F.col("image"), F.col("codec"), F.col("target_metric"), F.col("target_value"), F.col("sub_sampling"), F.lit(0))
    return rows.select("path", "codec", "sub_sampling", name.alias("id"), grid.id_status(name).alias("status"))


@query(IC + f" SELECT path, name AS codec, subsampling AS sub_sampling, {_ID.format(size='width::VARCHAR, ' + chr(39) + 'x' + chr(39) + ', height::VARCHAR, ' + chr(39) + 'x30' + chr(39))} AS id FROM images CROSS JOIN catalog WHERE media = 'video' AND mode = 'lossy'")
def trial_id_video(spark, sf_dir):
    named = images(spark, sf_dir).withColumn("image", grid.image_part(F.col("path"), [F.col("width"), F.col("height"), F.lit(30)]))
    rows = grid.trial_grid(named, _lossy(spark, "video")).withColumn("target_value", F.lit(40.0))
    name = grid.trial_id(F.col("image"), F.col("codec"), F.col("target_metric"), F.col("target_value"), F.col("sub_sampling"), F.lit(0))
    return rows.select("path", "codec", "sub_sampling", name.alias("id"))


@query(E_ + " SELECT id, codec, target_value FROM encodes WHERE id NOT IN (SELECT id FROM encodes WHERE file_size_bytes < 20000)")
def missing_trials(spark, sf_dir):
    rows = encodes(spark, sf_dir)
    return grid.missing_trials(rows.select("id", "codec", "target_value"), rows.where("file_size_bytes < 20000"))


@query(E_ + " SELECT id, count(*)::BIGINT AS stored FROM (SELECT id FROM encodes UNION ALL SELECT id FROM encodes WHERE target_value = 20) GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    rows = encodes(spark, sf_dir).select("id", "target_value")
    return grid.duplicate_ids(rows.union(rows.where("target_value = 20")))


BATCHES = _with("images") + ", b AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS frame_no FROM images), f AS (SELECT path, frame_no, frame_no // 30 AS batch_id, 'YUV_' || lpad((frame_no // 30)::VARCHAR, greatest(4, length((frame_no // 30)::VARCHAR))::INTEGER, '0') || '/IMG_' || lpad(frame_no::VARCHAR, greatest(4, length(frame_no::VARCHAR))::INTEGER, '0') || '.png' AS new_name FROM b)"


@query(BATCHES + " SELECT * FROM f")
def frame_batches(spark, sf_dir):
    return grid.frame_batches(images(spark, sf_dir).select("path"), 30).select("path", "frame_no", "batch_id", "new_name")


@query(BATCHES + " SELECT batch_id, count(*)::BIGINT AS frames FROM f GROUP BY batch_id")
def batch_frames(spark, sf_dir):
    return grid.batch_frames(grid.frame_batches(images(spark, sf_dir).select("path"), 30))


@query(_with("images") + " SELECT path, CASE WHEN width = 704 AND height = 512 AND depth = 8 THEN 'ok' ELSE 'mismatch' END AS status FROM images")
def uniform_dims(spark, sf_dir):
    return grid.uniform_dims(images(spark, sf_dir), 704, 512, 8).select("path", "status")


@query(_with("images") + " SELECT path, width FROM images WHERE depth = 16 AND colorspace = 'Gray'")
def depth_colorspace_filter(spark, sf_dir):
    return grid.depth_colorspace_filter(images(spark, sf_dir), 16, "Gray").select("path", "width")


@query(_with("images") + r", s AS (SELECT path, regexp_extract(path, '([^/]*)\.[^./]*$', 1) AS stem FROM images) SELECT path, '/out/' || stem || '_RG.png' AS rg, '/out/' || stem || '_L8.png' AS l8, '/out/' || substr(stem, 1, length(stem) - 3) || '_HDR.png' AS hdr FROM s")
def derived_path(spark, sf_dir):
    return images(spark, sf_dir).select("path", *[paths.derived_path(F.col("path"), "/out", k).alias(k.lower()) for k in ("RG", "L8", "HDR")])


# --- 2.4 trials


@query()
def run_trials(spark, sf_dir):
    docs = fixtures.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("binary").alias("payload"))
    plan = docs.select("id", F.explode(F.array(F.lit("zlib"), F.lit("bz2"), F.lit("lzma"))).alias("codec"), F.lit(1).alias("param"), "payload")
    return trials.run_trials(plan)


@query(
    """
WITH d AS (SELECT doc_id::VARCHAR AS id, encode(text) AS b, regexp_replace(hex(encode(text)), '.(.)', '\\1', 'g') AS low FROM documents),
n AS (SELECT id, octet_length(b)::BIGINT AS n, b IS NULL AS bad, length(regexp_replace(low, '[^159D]', '', 'g')) + 4 * length(regexp_replace(low, '[^26AE]', '', 'g')) + 9 * length(regexp_replace(low, '[^37BF]', '', 'g')) AS sse FROM d),
t AS (SELECT id, 'zlib' AS codec, n, bad, sse * 0 AS sse FROM n UNION ALL SELECT id, 'coarse', n, bad, sse FROM n)
SELECT id, codec, n AS source_bytes, sse::BIGINT AS sse, CASE WHEN sse > 0 THEN round(10 * log10(65025e0 * n / sse), 6) END AS psnr, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status FROM t
"""
)
def measured_trials(spark, sf_dir):
    docs = fixtures.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("binary").alias("payload"))
    plan = docs.select("id", F.explode(F.array(F.lit("zlib"), F.lit("coarse"))).alias("codec"), F.lit(2).alias("param"), "payload")
    rows = trials.run_trials(plan, trials.encode_decode_measure, trials.MEASURED_SCHEMA)
    return rows.select("id", "codec", "source_bytes", "sse", F.when(F.col("sse") > 0, r6("psnr")).alias("psnr"), "status")


@query(E_ + " SELECT id, round(width * height * frames * depth / 8, 6) AS source_file_size, round(file_size_bytes * 8 / (width * height * frames), 6) AS bpp, round(width * height * frames * depth / 8 / file_size_bytes, 6) AS compress_rate FROM encodes")
def trial_rates(spark, sf_dir):
    return trials.trial_rates(encodes(spark, sf_dir)).select("id", *[r6(c).alias(c) for c in ("source_file_size", "bpp", "compress_rate")])


@query(E_ + " SELECT id, round(file_size_bytes * 8 / (width * height), 6) AS rate FROM encodes")
def rate_from_pixels(spark, sf_dir):
    return encodes(spark, sf_dir).select("id", r6(trials.rate_from_pixels(F.col("file_size_bytes"), F.col("width") * F.col("height"))).alias("rate"))


@query(E_ + " SELECT id, vmaf, CASE WHEN codec = 'hevc' THEN ssim + 1 ELSE ssim END AS ssim, CASE WHEN codec = 'hevc' THEN psnr_avg END AS psnr_avg, file_size_bytes FROM encodes")
def merge_metrics(spark, sf_dir):
    rows = encodes(spark, sf_dir)
    second = rows.where("codec = 'hevc'").select("id", (F.col("ssim") + 1).alias("ssim"), "psnr_avg")
    return logs.merge_metrics(rows.select("id", "vmaf", "ssim"), second, ["id"], rows.select("id", "file_size_bytes"))


SEARCH = """
WITH RECURSIVE w AS (SELECT s_suppkey, target FROM supplier CROSS JOIN (VALUES (25e0), (31.3e0), (35e0), (60e0)) AS t(target)),
s AS (
  SELECT s_suppkey, target, 0e0 AS a, 100e0 AS b, NULL::DOUBLE AS param, NULL::DOUBLE AS quality, 0 AS trials, false AS hit FROM w
  UNION ALL
  SELECT s_suppkey, target, CASE WHEN q < target THEN c ELSE a END, CASE WHEN q < target THEN b ELSE c END, c, q, trials + 1, abs(q - target) < 0.125e0
  FROM (SELECT *, (a + b) / 2 AS c, 20 + s_suppkey % 7 + 0.25e0 * ((a + b) / 2) AS q FROM s WHERE NOT hit AND b - a > 0.5e0))
SELECT {key}, target, param, quality, trials, CASE WHEN hit THEN 'hit' WHEN trials > 0 THEN 'exhausted' ELSE 'no_trial' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey, target ORDER BY trials DESC) AS n FROM s) WHERE n = 1
"""


@query(SEARCH.replace("{key}", "s_suppkey"))
def target_search(spark, sf_dir):
    rows = fixtures.read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(*map(F.lit, (25.0, 31.3, 35.0, 60.0)))).alias("target"))
    found = trials.bisect(F.lit(0.0), F.lit(100.0), F.lit(0.5), F.col("target"), F.lit(0.125), F.lit(False), lambda c: 20 + F.col("s_suppkey") % 7 + 0.25 * c, 8)
    return rows.withColumn("x", found).select("s_suppkey", "target", "x.*")


def _quality_by_id(frames):
    """A measure over partitions: the quality of a trial from its id and parameter."""
    for pdf in frames:
        yield pdf.assign(quality=20 + pdf["id"].str.split("|").str[0].astype("int64") % 7 + 0.25 * pdf["param"])[["id", "quality"]]


@query(SEARCH.replace("{key}", "concat(s_suppkey::VARCHAR, '|', (target * 10)::INTEGER::VARCHAR) AS id"))
def target_search_rounds(spark, sf_dir):
    rows = fixtures.read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(*map(F.lit, (25.0, 31.3, 35.0, 60.0)))).alias("target"))
    key = F.concat(F.col("s_suppkey").cast("string"), F.lit("|"), F.round(F.col("target") * 10).cast("int").cast("string"))
    work = rows.select(key.alias("id"), F.lit(0.0).alias("a"), F.lit(100.0).alias("b"), F.lit(0.5).alias("ab_tol"), "target", F.lit(0.125).alias("tolerance"), F.lit(False).alias("inverse"))
    return trials.target_search(work, _quality_by_id, 8, lambda df, i: written(df, f"round{i}"))


SWEEP = """
WITH d AS (SELECT doc_id::VARCHAR AS id, hex(encode(text)) AS h FROM documents),
b AS (SELECT id, ('0x' || x)::INTEGER AS v, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(h, '..')) AS x FROM d) GROUP BY id, x),
s AS (SELECT d.id, k, coalesce(sum(n), 0) AS n, coalesce(sum(n * (v & ((1 << k) - 1)) * (v & ((1 << k) - 1))), 0) AS sse FROM d CROSS JOIN range(8) t(k) LEFT JOIN b ON b.id = d.id WHERE h IS NOT NULL GROUP BY d.id, k),
q AS (SELECT id, k, CASE WHEN sse = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025e0 * n / CASE WHEN sse = 0 THEN 1 ELSE sse END) END AS q FROM s),
p AS (SELECT d.id, target, k, q, row_number() OVER (PARTITION BY d.id, target ORDER BY abs(q - target), q >= target DESC, CASE WHEN q >= target THEN -k ELSE k END) AS rn FROM d CROSS JOIN (VALUES (20e0), (33e0), (41.5e0), (48e0)) t(target) LEFT JOIN q ON q.id = d.id)
SELECT id, target, k::INTEGER AS param, round(q, 6) AS quality, CASE WHEN q IS NULL THEN 'error' ELSE 'hit' END AS status FROM p WHERE rn = 1
"""


@query(SWEEP)
def target_search_trials(spark, sf_dir):
    # each round encodes, decodes and measures; payloads lie in buckets and are never shuffled again
    docs = fixtures.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("binary").alias("payload"))
    path = new_path(spark, "payloads")
    table, many = path.rsplit("/", 1)[1].replace("-", "_"), buckets.even(spark)
    docs.repartition(many, "id").write.format("parquet").option("path", path).bucketBy(many, "id").sortBy("id").saveAsTable(table)
    with_payload = lambda tries: tries.repartition(many, "id").hint("shuffle_hash").join(spark.table(table), "id").withColumn("codec", F.lit("coarse"))
    wanted = docs.select("id", F.explode(F.array(*map(F.lit, (20.0, 33.0, 41.5, 48.0)))).alias("target"))
    found = trials.search_measured(wanted, 0, 7, trials.encode_decode_measure, with_payload, written)
    return found.select("id", "target", "param", r6("quality").alias("quality"), "status")


TRIED = "SELECT doc_id::VARCHAR || ' ' || codec AS id, codec, octet_length(encode(text))::BIGINT AS source_bytes, CASE WHEN codec = 'unknown' OR text IS NULL THEN 'error' ELSE 'ok' END AS status{more} FROM documents CROSS JOIN (VALUES ('zlib'), ('bz2'), ('lzma'), ('unknown')) t(codec)"


def _trial_plan(spark, sf_dir):
    docs = fixtures.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("text").cast("binary").alias("payload"))
    codec = F.explode(F.array(*map(F.lit, ("zlib", "bz2", "lzma", "unknown")))).alias("codec")
    plan = docs.select("source", codec, F.octet_length("payload").alias("size"))
    cost = F.col("size") * F.coalesce(*[F.when(F.col("codec") == k, v) for k, v in isolated.COST.items()], F.lit(0.0))
    return docs, plan.select(F.concat_ws(" ", "source", "codec").alias("trial"), "source", "codec", F.lit(1).alias("param"), cost.alias("cost"))


@query(TRIED.format(more=""))
def trials_udtf(spark, sf_dir):
    isolated.register(spark)
    docs, plan = _trial_plan(spark, sf_dir)
    return isolated.run_dealt(plan, docs, isolated.bins_for(spark)).select("id", "codec", "source_bytes", "status")


@query(TRIED.format(more=", CASE WHEN codec = 'zlib' THEN 1 ELSE 2 END AS run"))
def trials_resumed(spark, sf_dir):
    # a run that stops after the trials of one codec; the next one runs only the others
    isolated.register(spark)
    docs, plan = _trial_plan(spark, sf_dir)
    path = new_path(spark, "results")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets.create(spark, table, path, T.StructType([*T.StructType.fromDDL(isolated.SCHEMA), T.StructField("run", T.IntegerType())]), 16)
    isolated.resume(plan.where("codec = 'zlib'"), docs, table, isolated.bins_for(spark), 1)
    isolated.resume(plan, docs, table, isolated.bins_for(spark), 2)
    return spark.table(table).select("id", "codec", "source_bytes", "status", "run")


@query(E_ + " SELECT sub_sampling, codec, source, codec_param, psnr_avg AS quality, abs(psnr_avg - 33) < 1 AS inside FROM (SELECT *, row_number() OVER (PARTITION BY sub_sampling, codec, source ORDER BY abs(psnr_avg - 33), codec_param, id) AS n FROM encodes) WHERE n = 1")
def target_pick(spark, sf_dir):
    return trials.target_pick(encodes(spark, sf_dir), "psnr_avg", 33.0, 1.0)


@query(EC + " SELECT name AS codec, subsampling AS sub_sampling, CASE WHEN param_end - param_start <= ab_tol OR ab_tol <= 0 THEN 0 ELSE ceil(log2((param_end - param_start) / ab_tol))::INTEGER END AS trials, (SELECT count(*) FROM encodes e WHERE e.codec = name AND e.sub_sampling = subsampling)::BIGINT AS measured FROM catalog WHERE media = 'image' AND depth = 8 AND mode = 'lossy'")
def search_budget(spark, sf_dir):
    n = encodes(spark, sf_dir).groupBy(F.col("codec").alias("name"), F.col("sub_sampling").alias("subsampling")).agg(F.count("*").alias("n"))
    rows = _lossy(spark).join(n, ["name", "subsampling"], "left")
    return rows.select(F.col("name").alias("codec"), F.col("subsampling").alias("sub_sampling"), trials.search_budget(F.col("param_end") - F.col("param_start"), F.col("ab_tol")).alias("trials"), F.coalesce("n", F.lit(0)).alias("measured"))


@query(IC + " SELECT path, name AS codec, subsampling AS sub_sampling, m AS mode, CASE WHEN m = 'lossless' THEN 0 WHEN m = 'auto' THEN param_start ELSE (param_start + param_end) / 2 END AS first_param FROM images CROSS JOIN catalog CROSS JOIN (VALUES ('auto'), ('customize'), ('lossless')) AS k(m) WHERE media = 'video' AND mode = 'lossy'")
def trial_modes(spark, sf_dir):
    rows = grid.trial_grid(images(spark, sf_dir), _lossy(spark, "video")).withColumn("param", F.col("param_start"))
    return grid.all_modes(rows).select("path", "codec", "sub_sampling", "mode", "first_param")


# --- 2.5 samples

S_ = _with("samples")
PSNR = "CASE WHEN sse = 0 THEN NULL ELSE round(10 * log10({peak} * {peak} * n / CASE WHEN sse = 0 THEN 1 ELSE sse END), 6) END"


@query(S_ + f" SELECT image, plane, n AS samples, sse, {PSNR.format(peak='65535e0')} AS psnr FROM (SELECT image, plane, count(*)::BIGINT AS n, sum((v - w) * (v - w))::BIGINT AS sse FROM samples GROUP BY ALL)")
def plane_psnr(spark, sf_dir):
    return pixels.plane_psnr(samples(spark, sf_dir)).withColumn("psnr", r6("psnr"))


@query(S_ + ", m AS (SELECT image, plane, sum((v - w) * (v - w)) / count(*) AS mse FROM samples GROUP BY GROUPING SETS ((image, plane), (image))) SELECT image, coalesce(plane, 'ALL') AS plane, round(mse, 6) AS mse FROM m")
def plane_mse(spark, sf_dir):
    return pixels.plane_mse(samples(spark, sf_dir)).withColumn("mse", r6("mse"))


@query(S_ + f", d AS (SELECT image, plane, (v >> 8) - least(greatest((w + 128) >> 8, 0), 255) AS d FROM samples) SELECT image, plane, n AS samples, sse, {PSNR.format(peak='255e0')} AS psnr FROM (SELECT image, plane, count(*)::BIGINT AS n, sum(d * d)::BIGINT AS sse FROM d GROUP BY ALL)")
def depth_shift_psnr(spark, sf_dir):
    return pixels.plane_psnr(pixels.depth_shift(samples(spark, sf_dir), 8, 16), bits=8).withColumn("psnr", r6("psnr"))


@query(
    S_ + ", p AS (SELECT label AS seq, image AS frame, 10 * log10(65535e0 * 65535e0 * count(*) / sum((v - w) * (v - w))) AS psnr FROM samples WHERE plane = 'Y' GROUP BY label, image)"
    " SELECT seq, frame, round(psnr, 6) AS psnr, round(avg(psnr) OVER (PARTITION BY seq ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) AS running FROM p"
)
def sequence_psnr(spark, sf_dir):
    rows = samples(spark, sf_dir).where("plane = 'Y'")
    of = rows.groupBy("image").agg(F.first("label").alias("seq"))
    frames = pixels.plane_psnr(rows).join(of, "image").select("seq", F.col("image").alias("frame"), "psnr")
    return pixels.sequence_psnr(frames).select("seq", "frame", r6("psnr").alias("psnr"), r6("running").alias("running"))


@query(
    S_ + ", p AS (SELECT concat(label::VARCHAR, ' ', plane) AS seq, image AS frame, 10 * log10(65535e0 * 65535e0 * count(*) / sum((v - w) * (v - w))) AS psnr FROM samples GROUP BY label, plane, image)"
    " SELECT seq, frame, round(psnr, 6) AS psnr, round(avg(psnr) OVER (PARTITION BY seq ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) AS running FROM p"
)
def sequence_psnr_planes(spark, sf_dir):
    rows = samples(spark, sf_dir)
    of = rows.groupBy("image").agg(F.first("label").alias("label"))
    frames = pixels.plane_psnr(rows).join(of, "image").select(F.concat(F.col("label").cast("string"), F.lit(" "), "plane").alias("seq"), F.col("image").alias("frame"), "psnr")
    return pixels.sequence_psnr(frames).select("seq", "frame", r6("psnr").alias("psnr"), r6("running").alias("running"))


@query(S_ + f" SELECT image, n AS samples, sse, {PSNR.format(peak='65535e0')} AS psnr FROM (SELECT image, count(*)::BIGINT AS n, sum((v - w) * (v - w))::BIGINT AS sse FROM samples GROUP BY image)")
def field_merge_psnr(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns({"line": F.expr("idx div 8"), "x": F.col("idx") % 8})
    fields = rows.select("image", (F.col("line") % 2).alias("field"), F.expr("line div 2").alias("row"), "x", "w")
    return pixels.field_merge_psnr(fields, rows.select("image", "line", "x", "v"), 16, 8).withColumn("psnr", r6("psnr"))


COUNTERS = "c AS (SELECT user_id AS seq, event_id AS frame, CASE WHEN event_id % 12 = 0 THEN 'I' WHEN event_id % 3 = 0 THEN 'P' ELSE 'B' END AS kind, CAST(round(value * 100) AS BIGINT) AS bits FROM events)"


def _counters(spark, sf_dir):
    bits = F.round(F.col("value") * 100).cast("long")
    kind = F.when(F.col("event_id") % 12 == 0, "I").when(F.col("event_id") % 3 == 0, "P").otherwise("B")
    rows = fixtures.read(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), F.col("event_id").alias("frame"), kind.alias("kind"), bits.alias("b"), (bits % 7).alias("duplicate"))
    return rows.withColumn("counter", F.expr("sum(b) over (partition by seq order by frame)")).drop("b")


@query(f"WITH {COUNTERS} SELECT seq, sum(CASE WHEN kind = 'I' THEN bits ELSE 0 END)::BIGINT AS i_bits, sum(CASE WHEN kind = 'P' THEN bits ELSE 0 END)::BIGINT AS p_bits, sum(CASE WHEN kind = 'B' THEN bits ELSE 0 END)::BIGINT AS b_bits, count(*)::BIGINT AS frames FROM c GROUP BY seq")
def bits_by_type(spark, sf_dir):
    return pixels.bits_by_type(_counters(spark, sf_dir))


@query(f"WITH {COUNTERS} SELECT seq, round(sum(bits) * 25 / count(*) / 1000, 6) AS kbps, round((sum(bits) - sum(bits % 7)) * 25 / count(*) / 1000, 6) AS kbps_without_duplicates FROM c GROUP BY seq")
def bitrate(spark, sf_dir):
    return pixels.bitrate(_counters(spark, sf_dir), 25.0).select("seq", r6("kbps").alias("kbps"), r6("kbps_without_duplicates").alias("kbps_without_duplicates"))


@query(S_ + " SELECT image, md5(string_agg(v::VARCHAR, ',' ORDER BY idx)) AS digest FROM samples GROUP BY image")
def frame_digest(spark, sf_dir):
    return pixels.frame_digest(samples(spark, sf_dir))


def _planes(spark, sf_dir):
    """The samples as arrays: one row an image, nothing exploded."""
    v = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 32767).cast("int"))
    rows = fixtures.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), v.alias("v"))
    return rows.withColumn("w", F.transform("v", lambda x: F.floor(x / 64).cast("int") * 64 + 32))


def _tiles(spark, sf_dir):
    part = lambda name, at, n: F.struct(F.lit(name).alias("plane"), F.slice("v", at, n).alias("v"), F.slice("w", at, n).alias("w"))
    rows = _planes(spark, sf_dir).select("image", F.explode(F.array(part("Y", 1, 42), part("U", 43, 11), part("V", 54, 11))).alias("x")).select("image", "x.plane", "x.v", "x.w")
    return rows.select("image", "plane", F.lit(0).alias("line"), F.size("v").alias("width"), tiles.pack("v").alias("v"), tiles.pack("w").alias("w"))


@query(SQL["plane_psnr"])
def plane_psnr_tiles(spark, sf_dir):
    return tiles.plane_psnr(_tiles(spark, sf_dir)).withColumn("psnr", r6("psnr"))


@query(SQL["plane_mse"])
def plane_mse_tiles(spark, sf_dir):
    return tiles.plane_mse(_tiles(spark, sf_dir)).withColumn("mse", r6("mse"))


@query(SQL["depth_shift_psnr"])
def depth_shift_psnr_tiles(spark, sf_dir):
    return tiles.plane_psnr(tiles.depth_shift(_tiles(spark, sf_dir), 8, 16), bits=8).withColumn("psnr", r6("psnr"))


@query(SQL["field_merge_psnr"])
def field_merge_psnr_tiles(spark, sf_dir):
    # images of 8 lines of 8 samples, in two blocks of 4 lines
    planes = _planes(spark, sf_dir)
    line = lambda k: F.slice("w", 8 * k + 1, 8)
    field = lambda block, k: F.struct(F.lit(block).alias("block"), F.lit(k).alias("field"), F.concat(line(4 * block + k), line(4 * block + k + 2)).alias("w"))
    fields = planes.select("image", F.explode(F.array(*[field(b, k) for b in (0, 1) for k in (0, 1)])).alias("x")).select("image", "x.block", "x.field", F.lit(8).alias("width"), tiles.pack("x.w").alias("w"))
    frames = planes.select("image", F.posexplode(F.array(F.slice("v", 1, 32), F.slice("v", 33, 32))).alias("block", "v")).select("image", "block", tiles.pack("v").alias("v"))
    return tiles.field_merge_psnr(fields, frames, 16).withColumn("psnr", r6("psnr"))


@query(SQL["frame_digest"])
def frame_digest_tiles(spark, sf_dir):
    return tiles.frame_digest(_tiles(spark, sf_dir))


@query(S_ + " SELECT image, idx, v >> 8 AS r, v & 255 AS g, 0 AS b FROM samples")
def hdr_to_rg(spark, sf_dir):
    r, g, b = pixels.hdr_to_rg(F.col("v"))
    return samples(spark, sf_dir).select("image", "idx", r.alias("r"), g.alias("g"), b.alias("b"))


@query(S_ + " SELECT image, idx, v, true AS same FROM samples")
def rg_to_hdr(spark, sf_dir):
    r, g, _ = pixels.hdr_to_rg(F.col("v"))
    back = pixels.rg_to_hdr(r, g)
    return samples(spark, sf_dir).select("image", "idx", back.alias("v"), (back == F.col("v")).alias("same"))


@query(S_ + " SELECT image, idx, least(v, 255) AS v FROM samples")
def hdr_to_l8(spark, sf_dir):
    return samples(spark, sf_dir).select("image", "idx", pixels.hdr_to_l8(F.col("v")).alias("v"))


# --- 2.6 running totals

C_ = _with("completions")
KEYS = "codec, sub_sampling, target_metric, target_value"


@query(C_ + f" SELECT {KEYS}, sum(bytes)::BIGINT AS total_bytes FROM completions WHERE status = 'ok' GROUP BY ALL")
def total_bytes(spark, sf_dir):
    return totals.total_bytes(completions(spark, sf_dir))


@query(C_ + f" SELECT {KEYS}, round(sum(vmaf), 4) AS total_metric FROM completions WHERE status = 'ok' GROUP BY {KEYS}")
def total_metric(spark, sf_dir):
    return totals.total_metric(completions(spark, sf_dir)).withColumn("total_metric", F.round("total_metric", 4))


@query(C_ + " SELECT codec, sub_sampling, count(*) FILTER (WHERE status = 'error')::BIGINT AS errors FROM completions GROUP BY ALL")
def total_errors(spark, sf_dir):
    return totals.total_errors(completions(spark, sf_dir))


def _keys(spark, sf_dir):
    return completions(spark, sf_dir).select(*totals.KEYS).distinct()


@query(C_ + f" SELECT {KEYS}, coalesce(sum(bytes) FILTER (WHERE status = 'ok'), 0) / 1000 AS payload_kb FROM completions GROUP BY {KEYS}")
def payload_report(spark, sf_dir):
    return totals.payload_report(_keys(spark, sf_dir), totals.total_bytes(completions(spark, sf_dir)))


@query(C_ + " SELECT codec, sub_sampling, coalesce(sum(bytes) FILTER (WHERE status = 'ok'), 0) / 1000 AS payload_kb FROM completions GROUP BY codec, sub_sampling")
def payload_lossless(spark, sf_dir):
    return totals.payload_lossless(completions(spark, sf_dir))


@query(
    C_ + f", n AS (SELECT count(*) AS n FROM part), e AS (SELECT codec, sub_sampling, count(*) FILTER (WHERE status = 'error')::BIGINT AS errors FROM completions GROUP BY ALL), t AS (SELECT {KEYS}, coalesce(sum(vmaf) FILTER (WHERE status = 'ok'), 0) AS s FROM completions GROUP BY {KEYS})"
    f" SELECT {', '.join('t.' + k for k in KEYS.split(', '))}, round(s / n, 6) AS image_metric, round(s / CASE WHEN errors > 0 THEN n ELSE 1 END, 6) AS video_metric, errors FROM t JOIN e USING (codec, sub_sampling) CROSS JOIN n"
)
def metric_over_images(spark, sf_dir):
    done = completions(spark, sf_dir)
    return totals.metrics_over_images(done, images(spark, sf_dir)).withColumns({"image_metric": r6("image_metric"), "video_metric": r6("video_metric")})


def _stream(spark, sf_dir):
    path = new_path(spark, "completions")
    rows = completions(spark, sf_dir)
    rows.repartition(4, "event_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(C_ + f" SELECT {KEYS}, coalesce(sum(bytes) FILTER (WHERE status = 'ok'), 0)::BIGINT AS total_bytes, round(coalesce(sum(vmaf) FILTER (WHERE status = 'ok'), 0), 4) AS total_metric, count(*) FILTER (WHERE status = 'error')::BIGINT AS errors FROM completions GROUP BY {KEYS}")
def stream_totals(spark, sf_dir):
    path = new_path(spark, "totals")
    streaming.stream_totals(_stream(spark, sf_dir), path, new_path(spark, "state"))
    return streaming.latest_totals(spark, path).withColumn("total_metric", F.round("total_metric", 4))


@query(C_ + " SELECT concat('e', (event_id % 997)::VARCHAR) AS id, min(event_id)::BIGINT AS event_id, arg_min(bytes, event_id)::BIGINT AS bytes FROM completions GROUP BY event_id % 997")
def stream_upsert(spark, sf_dir):
    # all files in one batch, in which the smallest arrival of an id counts
    source, path = new_path(spark, "completions"), new_path(spark, "upsert")
    rows = completions(spark, sf_dir).withColumn("id", F.concat(F.lit("e"), (F.col("event_id") % 997).cast("string")))
    rows.repartition(4, "event_id").write.parquet(source)
    streaming.stream_upsert(spark.readStream.schema(rows.schema).parquet(source), path, new_path(spark, "state"), "event_id")
    return spark.read.parquet(path).select("id", F.col("event_id").cast("long").alias("event_id"), F.col("bytes").cast("long").alias("bytes"))


@query(C_ + " SELECT concat('e', (event_id % 997)::VARCHAR) AS id, min(event_id)::BIGINT AS event_id, arg_min(status, event_id) AS status FROM completions GROUP BY event_id % 997")
def stream_upsert_first(spark, sf_dir):
    # four deliveries one after the other, in the order of arrival; the copies of an id meet in several batches
    source, path = new_path(spark, "completions"), new_path(spark, "upsert")
    rows = completions(spark, sf_dir).withColumn("id", F.concat(F.lit("e"), (F.col("event_id") % 997).cast("string")))
    most = rows.agg(F.max("event_id")).first()[0] or 0
    for k in range(4):
        rows.where((F.col("event_id") * 4 > k * most if k else F.lit(True)) & (F.col("event_id") * 4 <= (k + 1) * most)).repartition(4, "id").write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.stream_upsert(stream, path, new_path(spark, "state"), "event_id")
    return spark.read.parquet(path).select("id", F.col("event_id").cast("long").alias("event_id"), "status")


# --- 2.7 analysis


@query(
    E_ + ", u AS (SELECT DISTINCT 'codec' AS name, codec AS value, NULL::DOUBLE AS n FROM encodes UNION ALL SELECT DISTINCT 'sub_sampling', sub_sampling, NULL FROM encodes UNION ALL SELECT DISTINCT 'target_metric', target_metric, NULL FROM encodes UNION ALL SELECT DISTINCT 'target_value', target_value::VARCHAR, target_value FROM encodes)"
    " SELECT name, row_number() OVER (PARTITION BY name ORDER BY n, value)::INTEGER AS seq, value FROM u"
)
def distinct_sorted(spark, sf_dir):
    return analysis.distinct_sorted(encodes(spark, sf_dir), "codec", "sub_sampling", "target_metric", "target_value")


@query(E_ + " SELECT 'source' AS name, row_number() OVER (ORDER BY source)::INTEGER AS seq, source AS value FROM (SELECT DISTINCT source FROM encodes)")
def distinct_sources(spark, sf_dir):
    return analysis.distinct_ranked(encodes(spark, sf_dir), "source")


@query(E_ + " SELECT DISTINCT sub_sampling, codec FROM encodes")
def codecs_in_subsampling(spark, sf_dir):
    return analysis.codecs_in_subsampling(encodes(spark, sf_dir))


@query(E_ + ", i AS (SELECT DISTINCT width, height FROM encodes) SELECT count(*)::BIGINT AS sizes, min(width * height) = max(width * height) AS same, CASE WHEN min(width * height) = max(width * height) THEN min(width * height) END::BIGINT AS total_pixels FROM i")
def size_check(spark, sf_dir):
    return analysis.size_check(encodes(spark, sf_dir))


@query(E_ + " SELECT m AS metric, EXISTS (SELECT 1 FROM encodes WHERE target_metric = m) AS present FROM (VALUES ('psnr_avg'), ('vmaf')) AS t(m)")
def metric_check(spark, sf_dir):
    return analysis.metric_check(encodes(spark, sf_dir), ["psnr_avg", "vmaf"])


@query(E_ + " SELECT psnr_avg AS metric_value, file_size_bytes, vmaf, source, compress_rate, bpp FROM encodes WHERE codec = 'hevc' AND sub_sampling = '420' AND target_metric = 'psnr_avg' AND target_value = 40")
def slice(spark, sf_dir):  # noqa: A001
    return analysis.slice_of(encodes(spark, sf_dir), "hevc", "420", "psnr_avg", 40.0)


@query(E_ + f" SELECT {SLICE}, string_agg(source, ',' ORDER BY source) AS sources, string_agg(file_size_bytes::BIGINT::VARCHAR, ',' ORDER BY source) AS sizes FROM encodes GROUP BY {SLICE}")
def slice_columns(spark, sf_dir):
    rows = analysis.slice_columns(encodes(spark, sf_dir))
    return rows.select("sub_sampling", "codec", "target_metric", "target_value", F.array_join("sources", ",").alias("sources"), F.array_join(F.transform("file_size_bytess", lambda x: x.cast("long").cast("string")), ",").alias("sizes"))


@query(E_ + f" SELECT {SLICE}, string_agg(source, ',' ORDER BY source) AS sources, string_agg(file_size_bytes::BIGINT::VARCHAR, ',' ORDER BY source) AS sizes FROM encodes GROUP BY {SLICE}")
def slice_blocks(spark, sf_dir):
    # blocks of 64 rows, joined again for the comparison only
    rows = analysis.slice_blocks(encodes(spark, sf_dir), 64)
    part = F.struct("block", F.array_join("sources", ",").alias("sources"), F.array_join(F.transform("file_size_bytess", lambda x: x.cast("long").cast("string")), ",").alias("sizes"))
    x = rows.groupBy(*analysis.SLICE).agg(F.array_sort(F.collect_list(part)).alias("x"))
    return x.select(*analysis.SLICE, F.array_join("x.sources", ",").alias("sources"), F.array_join("x.sizes", ",").alias("sizes"))


@query(E_ + f" SELECT {SLICE}, round(avg(psnr_avg), 9) AS mean_metric, round(avg(file_size_bytes), 9) AS mean_bytes, count(*)::BIGINT AS images, round(avg(vmaf), 9) AS mean_vmaf, round(avg(compress_rate), 9) AS mean_compress_rate FROM encodes GROUP BY {SLICE}")
def slice_means(spark, sf_dir):
    rows = analysis.slice_means(encodes(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 9) for c in ("mean_metric", "mean_bytes", "mean_vmaf", "mean_compress_rate")})




@query(AVG + f" SELECT {SLICE}, images, round(q, 9) AS mean_metric, round(vmaf, 9) AS mean_vmaf, round(cr, 9) AS mean_compress_rate, round(reduction, 9) AS reduction FROM r")
def avg_reduction(spark, sf_dir):
    rows = analysis.avg_reduction(analysis.slice_means(encodes(spark, sf_dir)))
    return rows.withColumns({c: F.round(c, 9) for c in ("mean_metric", "mean_vmaf", "mean_compress_rate", "reduction")})


def _img_sql(baseline: str) -> str:
    return f", i AS (SELECT {', '.join('e.' + k for k in SLICE.split(', '))}, e.source, e.compress_rate, (e.file_size_bytes - j.file_size_bytes) / j.file_size_bytes * 100 AS reduction FROM encodes e JOIN encodes j ON j.codec = '{baseline}' AND j.sub_sampling = e.sub_sampling AND j.target_metric = e.target_metric AND j.target_value = e.target_value AND j.source = e.source)"


IMG = E_ + _img_sql("jpeg")


@query(IMG + f" SELECT {SLICE}, source, round(compress_rate, 6) AS compress_rate, round(reduction, 6) AS reduction FROM i")
def image_reduction(spark, sf_dir):
    return analysis.image_reduction(encodes(spark, sf_dir)).withColumns({c: r6(c) for c in ("compress_rate", "reduction")})


@query(
    E_ + f", k AS (SELECT DISTINCT {SLICE} FROM encodes), w AS (SELECT k.*, j.source FROM k JOIN encodes j ON j.codec = 'jpeg' AND j.sub_sampling = k.sub_sampling AND j.target_metric = k.target_metric AND j.target_value = k.target_value)"
    f" SELECT {SLICE}, source, a.y IS NOT NULL AS in_codec, b.y IS NOT NULL AS in_baseline FROM (SELECT {SLICE}, source, true AS y FROM encodes) a FULL JOIN (SELECT *, true AS y FROM w) b USING ({SLICE}, source) WHERE a.y IS NULL OR b.y IS NULL"
)
def source_alignment(spark, sf_dir):
    return analysis.source_alignment(encodes(spark, sf_dir))


@query(E_ + f" SELECT {SLICE}, source, round(compress_rate, 6) AS compress_rate FROM encodes")
def image_compress_rate(spark, sf_dir):
    return encodes(spark, sf_dir).select("sub_sampling", "codec", "target_metric", "target_value", "source", r6("compress_rate").alias("compress_rate"))


@query(IMG + f" SELECT {SLICE}, 'terse' AS kind, round(min(reduction), 6) AS max, round(max(reduction), 6) AS min FROM i GROUP BY {SLICE} UNION ALL SELECT {SLICE}, 'cr', round(max(compress_rate), 6), round(min(compress_rate), 6) FROM i GROUP BY {SLICE}")
def extrema(spark, sf_dir):
    return analysis.extrema(analysis.image_reduction(encodes(spark, sf_dir))).withColumns({"max": r6("max"), "min": r6("min")})


@query(
    IMG + f", n AS (SELECT *, row_number() OVER (PARTITION BY {SLICE} ORDER BY reduction, source) AS lo, row_number() OVER (PARTITION BY {SLICE} ORDER BY reduction DESC, source) AS hi FROM i)"
    f" SELECT {SLICE}, max(source) FILTER (WHERE lo = 1) AS best_source, round(max(reduction) FILTER (WHERE lo = 1), 6) AS best, max(source) FILTER (WHERE hi = 1) AS worst_source, round(max(reduction) FILTER (WHERE hi = 1), 6) AS worst FROM n GROUP BY {SLICE}"
)
def codec_extremes_image(spark, sf_dir):
    return analysis.extreme_images(analysis.image_reduction(encodes(spark, sf_dir))).withColumns({"best": r6("best"), "worst": r6("worst")})


@query(RD_SERIES + " SELECT * FROM s")
def rd_series(spark, sf_dir):
    return _series(spark, sf_dir).select("sub_sampling", "codec", "seq", r6("bpp").alias("bpp"), r6("quality").alias("quality"))


@query(RD_SERIES + " SELECT * FROM s WHERE strpos('kakadu-mse', codec) = 0")
def rd_series_filter(spark, sf_dir):
    rows = analysis.rd_series_filter(_series(spark, sf_dir), "kakadu-mse")
    return rows.select("sub_sampling", "codec", "seq", r6("bpp").alias("bpp"), r6("quality").alias("quality"))


CODECS = ["jpeg", "webp", "openjpeg", "bpg", "hevc", "avif-mse", "kakadu-mse"]
_PIVOT = ", ".join(f"round(max(CASE WHEN codec = '{c}' THEN reduction END), 6) AS \"{c}\"" for c in CODECS)


@query(
    IMG + f", m AS (SELECT {SLICE}, avg(file_size_bytes) AS b FROM encodes GROUP BY {SLICE}), a AS (SELECT m.*, (m.b - j.b) / j.b * 100 AS reduction FROM m JOIN m j ON j.codec = 'jpeg' AND j.sub_sampling = m.sub_sampling AND j.target_value = m.target_value),"
    " x AS (SELECT sub_sampling, target_value, codec, source AS \"row\", reduction FROM i UNION ALL SELECT sub_sampling, target_value, codec, 'avg', reduction FROM a UNION ALL SELECT sub_sampling, target_value, codec, 'max', min(reduction) FROM i GROUP BY ALL UNION ALL SELECT sub_sampling, target_value, codec, 'min', max(reduction) FROM i GROUP BY ALL)"
    f" SELECT sub_sampling, target_value, \"row\", {_PIVOT} FROM x GROUP BY sub_sampling, target_value, \"row\""
)
def report_matrix(spark, sf_dir):
    # trials, reductions and means are read several times, so each is computed once and written
    rows = written(encodes(spark, sf_dir).select(*analysis.SLICE, "source", "file_size_bytes", "compress_rate", "psnr_avg", "ssim", "vmaf"), "trials")
    of_images, means = written(analysis.image_reduction(rows), "reductions"), written(analysis.slice_means(rows), "means")
    out = analysis.report_matrix(of_images, analysis.avg_reduction(means), CODECS)
    return out.withColumns({c: r6(F.col(f"`{c}`")) for c in CODECS})


@query(AVG + " SELECT sub_sampling, codec, concat('avg Terse(', images::VARCHAR, ')') AS label, round(reduction, 6) AS reduction, round(cr, 6) AS mean_compress_rate FROM r WHERE target_value = 20")
def lossless_report(spark, sf_dir):
    rows = analysis.avg_reduction(analysis.slice_means(encodes(spark, sf_dir).where("target_value = 20")))
    return rows.select("sub_sampling", "codec", F.concat(F.lit("avg Terse("), F.col("images").cast("string"), F.lit(")")).alias("label"), r6("reduction").alias("reduction"), r6("mean_compress_rate").alias("mean_compress_rate"))


@query(AVG + " SELECT sub_sampling, codec, target_value, concat(rpad(concat('T ', target_value::VARCHAR, '(', images::VARCHAR, ')'), 20, ' '), ':', lpad(concat(printf('%.2f', reduction), '%'), 15, ' '), ' ', printf('%.2f', round(q, 9))) AS line FROM r")
def report_lines(spark, sf_dir):
    return report.report_lines(analysis.avg_reduction(analysis.slice_means(encodes(spark, sf_dir))))


@query(E_ + _img_sql("webp") + _avg_sql("webp") + f" SELECT 0 AS seq, concat(CASE WHEN length(source) >= 20 THEN source ELSE rpad(source, 20, ' ') END, ':', lpad(concat(printf('%.2f', reduction), '%'), 15, ' ')) AS line FROM i UNION ALL SELECT 1 AS seq, {LINE} FROM r")
def report_options(spark, sf_dir):
    rows = encodes(spark, sf_dir)
    return report.report(analysis.image_reduction(rows, "webp"), analysis.avg_reduction(analysis.slice_means(rows), "webp"), every_image=True, quiet=False)


# --- 2.8 BD rate

POINTS = E_ + ", pts AS (SELECT sub_sampling, codec, source, unnest(['vmaf', 'ssim', 'ms_ssim', 'vif', 'psnr_y', 'psnr_avg']) AS metric, unnest([vmaf, ssim, ms_ssim, vif, psnr_y, psnr_avg]) AS quality, file_size_bytes * 8 / (width * height) AS rate FROM encodes)"
CURVES = POINTS + """, d AS (SELECT DISTINCT * FROM pts),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY sub_sampling, metric, codec, source) AS n, lead(rate) OVER w AS nr, lead(quality) OVER w AS nq FROM d WINDOW w AS (PARTITION BY sub_sampling, metric, codec, source ORDER BY rate, quality)),
chk AS (SELECT sub_sampling, metric, codec, source, count(*) AS n, bool_and(nr IS NULL OR (rate < nr AND quality < nq)) AS monotonic, bool_and(rate <> 0) AS rates_ok, min(quality) AS q0, max(quality) AS q1 FROM o GROUP BY ALL),
good AS (SELECT * FROM chk WHERE n >= 4 AND monotonic AND rates_ok)"""
PCHIP = CURVES + """,
g0 AS (SELECT o.*, log10(rate) AS y, nq - quality AS h, (log10(nr) - log10(rate)) / (nq - quality) AS dl FROM o SEMI JOIN good USING (sub_sampling, metric, codec, source)),
g1 AS (SELECT *, lag(h) OVER w AS hp, lag(dl) OVER w AS dp, lead(h) OVER w AS hn, lead(dl) OVER w AS dn, lag(h, 2) OVER w AS hpp, lag(dl, 2) OVER w AS dpp FROM g0 WINDOW w AS (PARTITION BY sub_sampling, metric, codec, source ORDER BY i)),
g2 AS (SELECT *, CASE WHEN i = 1 THEN ((2 * h + hn) * dl - h * dn) / (h + hn) WHEN i = n THEN ((2 * hp + hpp) * dp - hp * dpp) / (hp + hpp) ELSE (3 * hp + 3 * h) / ((2 * h + hp) / dp + (h + 2 * hp) / dl) END AS e, CASE WHEN i = 1 THEN dl ELSE dp END AS e1, CASE WHEN i = 1 THEN dn ELSE dpp END AS e2 FROM g1),
g3 AS (SELECT *, CASE WHEN 1 < i AND i < n THEN e WHEN e * e1 < 0 THEN 0 WHEN e1 * e2 < 0 AND abs(e) > abs(3 * e1) THEN 3 * e1 ELSE e END AS d FROM g2),
g4 AS (SELECT *, lead(d) OVER (PARTITION BY sub_sampling, metric, codec, source ORDER BY i) AS d2 FROM g3),
seg AS (SELECT sub_sampling, metric, codec, source, i, quality AS x, y, h, dl, d, (3 * dl - 2 * d - d2) / h AS c, (d - 2 * dl + d2) / (h * h) AS b FROM g4 WHERE i < n)"""
BD = PCHIP + """,
pair AS (SELECT k.sub_sampling, k.metric, k.codec, k.source, a.n IS NOT NULL AND j.n IS NOT NULL AS fit, greatest(a.q0, j.q0) AS lo, least(a.q1, j.q1) AS hi
  FROM chk k LEFT JOIN good a ON a.sub_sampling = k.sub_sampling AND a.metric = k.metric AND a.codec = k.codec AND a.source = k.source
  LEFT JOIN good j ON j.sub_sampling = k.sub_sampling AND j.metric = k.metric AND j.codec = 'jpeg' AND j.source = k.source),
cut AS (SELECT p.*, 1 AS side, least(greatest(x, lo), hi) - x AS s0, least(greatest(x + h, lo), hi) - x AS s1, s.y, s.d, s.c, s.b FROM pair p JOIN seg s ON s.sub_sampling = p.sub_sampling AND s.metric = p.metric AND s.source = p.source AND s.codec = p.codec WHERE fit
  UNION ALL SELECT p.*, -1, least(greatest(x, lo), hi) - x, least(greatest(x + h, lo), hi) - x, s.y, s.d, s.c, s.b FROM pair p JOIN seg s ON s.sub_sampling = p.sub_sampling AND s.metric = p.metric AND s.source = p.source AND s.codec = 'jpeg' WHERE fit),
area AS (SELECT sub_sampling, metric, codec, source, sum(CASE WHEN s1 > s0 THEN side * ((s1 - s0) * y + (s1 * s1 - s0 * s0) * d / 2 + (s1 * s1 * s1 - s0 * s0 * s0) * c / 3 + (s1 * s1 * s1 * s1 - s0 * s0 * s0 * s0) * b / 4) ELSE 0 END) AS gap, sum(CASE WHEN side = 1 AND s1 > s0 THEN (s1 - s0) * y + (s1 * s1 - s0 * s0) * d / 2 + (s1 * s1 * s1 - s0 * s0 * s0) * c / 3 + (s1 * s1 * s1 * s1 - s0 * s0 * s0 * s0) * b / 4 ELSE 0 END) AS va FROM cut GROUP BY ALL),
bd AS (SELECT p.sub_sampling, p.metric, p.codec, p.source, CASE WHEN NOT fit THEN 'exception' WHEN lo >= hi THEN 'no_overlap' ELSE 'ok' END AS status,
  CASE WHEN NOT fit THEN NULL WHEN lo >= hi THEN -1000000e0 ELSE round(100 * (pow(10, gap / (hi - lo)) - 1), 6) + 0e0 END AS bd_rate FROM pair p LEFT JOIN area USING (sub_sampling, metric, codec, source)),
black AS (SELECT DISTINCT sub_sampling, metric, source FROM bd WHERE status = 'exception'),
mean AS (SELECT b.sub_sampling, b.metric, codec, round(avg(CASE WHEN k.source IS NULL THEN bd_rate END), 4) AS bd_rate, count(CASE WHEN k.source IS NULL THEN 1 END)::BIGINT AS sources FROM bd b LEFT JOIN black k ON k.sub_sampling = b.sub_sampling AND k.metric = b.metric AND k.source = b.source GROUP BY ALL)"""
KEY = "sub_sampling, metric, codec, source"


def _long(spark, sf_dir):
    return bdrate.rd_points_long(bdrate.rd_points(encodes(spark, sf_dir)))


def _marked(spark, sf_dir):
    return bdrate.bd_rate(_long(spark, sf_dir)).withColumn("bd_rate", r6("bd_rate") + 0.0)


def _rates(spark, sf_dir):
    return _marked(spark, sf_dir).drop("out")


@query(E_ + " SELECT sub_sampling, codec, source, target_metric, target_value, round(file_size_bytes * 8 / (width * height), 6) AS rate, vmaf, ssim, ms_ssim, vif, psnr_y, psnr_avg FROM encodes")
def rd_points(spark, sf_dir):
    return bdrate.rd_points(encodes(spark, sf_dir)).withColumn("rate", r6("rate"))


@query(POINTS + " SELECT sub_sampling, codec, source, round(rate, 6) AS rate, metric, quality FROM pts")
def rd_points_long(spark, sf_dir):
    return _long(spark, sf_dir).withColumn("rate", r6("rate"))


@query(CURVES + f" SELECT {KEY}, i::INTEGER AS seq, round(rate, 6) AS rate, quality FROM o")
def rd_dedup_order(spark, sf_dir):
    return bdrate.ordered_points(_long(spark, sf_dir)).withColumn("rate", r6("rate"))


@query(CURVES + f" SELECT {KEY}, n::INTEGER AS n_points, n >= 4 AS enough FROM chk")
def curve_min_points(spark, sf_dir):
    return bdrate.checked(bdrate.curves(_long(spark, sf_dir))).select(*bdrate.CURVE, "n_points", "enough")


@query(CURVES + f" SELECT {KEY}, monotonic FROM chk")
def curve_monotonic(spark, sf_dir):
    return bdrate.checked(bdrate.curves(_long(spark, sf_dir))).select(*bdrate.CURVE, "monotonic")


@query(CURVES + f" SELECT {KEY}, rates_ok FROM chk")
def curve_rates_ok(spark, sf_dir):
    return bdrate.checked(bdrate.curves(_long(spark, sf_dir))).select(*bdrate.CURVE, "rates_ok")


@query(BD + f" SELECT {KEY}, CASE WHEN fit THEN lo END AS lo, CASE WHEN fit THEN hi END AS hi, CASE WHEN fit THEN lo < hi END AS overlap FROM pair")
def curve_overlap(spark, sf_dir):
    return bdrate.paired(_long(spark, sf_dir)).select(*bdrate.CURVE, "lo", "hi", (F.col("lo") < F.col("hi")).alias("overlap"))


SLOPES = PCHIP + f" SELECT {KEY}, i::INTEGER AS seq, " + ", ".join(f"printf('%.5e', {x} + 0e0) AS {c}" for x, c in (("h", "h"), ("dl", "delta"), ("d", "d"), ("c", "c"), ("b", "b"))) + " FROM seg"


@F.arrow_udf(T.StringType())
def _digits(x: pa.Array) -> pa.Array:
    """Six significant digits of the exact value; Java's %e rounds its shortest decimal text a second time, and so ties upwards."""
    return pa.array([None if v is None else f"{v:.5e}" for v in x.to_pylist()], pa.string())


@query(SLOPES)
def pchip_slopes(spark, sf_dir):
    # all metrics; steps differ by orders of magnitude between them, so values are compared by significant digits
    rows = bdrate.paired(_long(spark, sf_dir)).select(*bdrate.CURVE, F.posexplode_outer("parts").alias("at", "p")).where("p is not null")
    return rows.select(*bdrate.CURVE, (F.col("at") + 1).alias("seq"), *[_digits(F.col(f"p.{c}") + 0.0).alias(c) for c in ("h", "delta", "d", "c", "b")])


@query(SLOPES)
def pchip_slopes_all(spark, sf_dir):
    return pchip_slopes(spark, sf_dir)


@query(BD + f" SELECT {KEY}, round(va, 6) AS area FROM pair JOIN area USING ({KEY}) WHERE fit AND lo < hi")
def clipped_integral(spark, sf_dir):
    rows = bdrate.paired(_long(spark, sf_dir)).where("fit and lo < hi")
    return rows.select(*bdrate.CURVE, r6(bdrate.clipped_integral(F.col("parts"), F.col("lo"), F.col("hi"))).alias("area"))


@query(BD + f" SELECT {KEY}, status, bd_rate FROM bd")
def bd_rate(spark, sf_dir):
    return _rates(spark, sf_dir)


@query(BD + f" SELECT {KEY}, status, CASE WHEN status = 'ok' THEN bd_rate END AS bd_rate FROM bd")
def bd_rate_strict(spark, sf_dir):
    return bdrate.bd_rate(_long(spark, sf_dir), strict=True).withColumn("bd_rate", r6("bd_rate") + 0.0).drop("out")


@query(BD + " SELECT sub_sampling, metric, codec, status, count(*)::BIGINT AS curves FROM bd GROUP BY ALL")
def bd_status(spark, sf_dir):
    return _rates(spark, sf_dir).groupBy("sub_sampling", "metric", "codec", "status").agg(F.count("*").alias("curves"))


@query(BD + " SELECT * FROM black")
def bd_blacklist(spark, sf_dir):
    return bdrate.blacklist(_rates(spark, sf_dir))


@query(BD + " SELECT sub_sampling, metric, concat(rpad(sub_sampling, 5, ' '), ' black list ', rpad(upper(metric), 8, ' '), ' BD RATE ', string_agg(source, ', ' ORDER BY source)) AS line FROM black GROUP BY sub_sampling, metric")
def bd_blacklist_lines(spark, sf_dir):
    return bdrate.blacklist_lines(_rates(spark, sf_dir))


def _means(spark, sf_dir):
    return bdrate.bd_mean(_marked(spark, sf_dir)).withColumn("bd_rate", F.round("bd_rate", 4))


@query(BD + " SELECT * FROM mean")
def bd_mean(spark, sf_dir):
    return _means(spark, sf_dir)


@query(BD + " SELECT sub_sampling, codec, " + ", ".join(f"max(CASE WHEN metric = '{m}' THEN bd_rate END) AS {m}" for m in BD_METRICS) + " FROM mean GROUP BY sub_sampling, codec")
def bd_matrix(spark, sf_dir):
    return bdrate.bd_matrix(_means(spark, sf_dir))


@query(POINTS + " SELECT sub_sampling, codec, count(*)::BIGINT AS points FROM pts WHERE NOT (codec = 'webp' AND sub_sampling = '444') GROUP BY ALL")
def bd_pair_rule(spark, sf_dir):
    return bdrate.pair_rule(_long(spark, sf_dir)).groupBy("sub_sampling", "codec").agg(F.count("*").alias("points"))


@query(
    BD + f" SELECT {KEY}, concat(CASE WHEN length(source) > 10 THEN substr(source, 1, 7) || '...' ELSE rpad(source, 10, ' ') END, ' ', codec, ' BDRate-', upper(metric), ' ', CASE WHEN status = 'exception' THEN 'BD_RATE_EXCEPTION' WHEN length(printf('%.2f', bd_rate)) >= 6 THEN printf('%.2f', bd_rate) ELSE lpad(printf('%.2f', bd_rate), 6, ' ') END) AS line FROM bd"
)
def bd_report_lines(spark, sf_dir):
    return report.bd_lines(_rates(spark, sf_dir), 10)


_MEAN = ", ".join(f"CASE WHEN max(CASE WHEN metric = '{m}' THEN bd_rate END) IS NULL THEN 'nan' ELSE printf('%.2f', max(CASE WHEN metric = '{m}' THEN bd_rate END)) END AS {m}" for m in BD_METRICS)


@query(
    BD + f", w AS (SELECT sub_sampling, codec, {_MEAN} FROM mean GROUP BY sub_sampling, codec)"
    " SELECT sub_sampling, codec, concat(rpad(codec, 16, ' '), " + ", ".join(f"'   Mean BDRate-{m.upper()} ', {m}" for m in BD_METRICS) + ") AS line,"
    " concat(rpad(codec, 16, ' '), " + ", ".join(f"lpad({m}, 22, ' ')" for m in BD_METRICS) + ") AS \"row\" FROM w"
)
def bd_mean_lines(spark, sf_dir):
    return report.bd_mean_lines(_means(spark, sf_dir), BD_METRICS)
