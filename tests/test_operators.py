"""Invariants of the codec-trial operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rdlab.operators import analysis, bdrate, pixels, report, trials
from rdlab.plans import catalog, grid
from rdlab.sources import files, logs, scratch, store


def curve(codec, rates, scale=1.0):
    return [("420", codec, "a.png", "vmaf", r * scale, 50.0 + 5 * i) for i, r in enumerate(rates)]


COLUMNS = "sub_sampling string, codec string, source string, metric string, rate double, quality double"


def test_catalog_has_all_rows(spark):
    assert catalog.codec_catalog(spark).count() == 100


def test_equal_curves_have_no_difference(spark):
    long = spark.createDataFrame(curve("jpeg", [1, 2, 4, 8, 9]) + curve("half", [1, 2, 4, 8, 9], 0.5), COLUMNS)
    got = {r["codec"]: r for r in bdrate.bd_rate(long).collect()}
    assert got["jpeg"]["bd_rate"] == 0
    assert abs(got["half"]["bd_rate"] + 50) < 1e-9


def test_bad_curves_are_exceptions_and_drop_their_source(spark):
    rows = curve("jpeg", [1, 2, 4, 8]) + curve("short", [1, 2, 3]) + curve("fine", [1, 2, 3, 4])
    rates = bdrate.bd_rate(spark.createDataFrame(rows, COLUMNS))
    assert {r["codec"]: r["status"] for r in rates.collect()} == {"jpeg": "ok", "short": "exception", "fine": "ok"}
    assert {r["codec"]: r["bd_rate"] for r in bdrate.bd_mean(rates).collect()} == {"jpeg": None, "short": None, "fine": None}


def test_no_overlap_is_a_sentinel_unless_strict(spark):
    far = [(s, "far", p, m, r, q + 1000) for s, _, p, m, r, q in curve("far", [1, 2, 3, 4])]
    long = spark.createDataFrame(curve("jpeg", [1, 2, 4, 8]) + far, COLUMNS)
    assert {r["codec"]: r["bd_rate"] for r in bdrate.bd_rate(long).collect()}["far"] == -1_000_000
    assert {r["codec"]: r["bd_rate"] for r in bdrate.bd_rate(long, strict=True).collect()}["far"] is None


def test_sweep_includes_both_ends(spark):
    rows = grid.param_sweep(catalog.codec_catalog(spark).where("name = 'hevc' and media = 'image' and depth = 8 and mode = 'lossy'"), 40)
    assert {(r["lo"], r["hi"]) for r in rows.groupBy("subsampling").agg(F.min("param").alias("lo"), F.max("param").alias("hi")).collect()} == {(10.0, 51.0)}


def test_nothing_is_missing_after_a_full_run(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    assert grid.missing_trials(rows, rows).isEmpty()


def test_numbering_follows_the_order(spark):
    rows = grid.numbered(spark.range(1000).withColumn("k", F.format_string("%05d", F.lit(5000) - F.col("id"))), "k")
    assert [r["number"] for r in rows.orderBy("k").collect()] == list(range(1000))


def test_first_arrival_wins(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "id string, arrival int")
    assert {(r["id"], r["arrival"]) for r in store.new_trials(new, spark.createDataFrame([("b",)], "id string"), "arrival").collect()} == {("a", 1)}


def test_planes_round_trip(spark):
    r, g, _ = pixels.hdr_to_rg(F.col("v"))
    assert spark.createDataFrame([(0,), (255,), (256,), (65535,)], "v long").where(pixels.rg_to_hdr(r, g) != F.col("v")).isEmpty()


def test_equal_planes_have_infinite_psnr(spark):
    rows = spark.createDataFrame([(1, "Y", 5, 5)], "image long, plane string, v long, w long")
    assert pixels.plane_psnr(rows, infinite=True).first()["psnr"] == float("inf")
    assert pixels.plane_psnr(rows).first()["psnr"] is None


def test_infinity_survives_the_log(spark):
    rows = logs.read_psnr_log(spark.createDataFrame([(1, "n:1 psnr_y:inf"), (1, "n:2 psnr_y:40.0")], "trial long, line string"))
    assert {r["key"]: r["mean"] for r in rows.collect()} == {"n": 1.5, "psnr_y": float("inf")}


def test_function_search_equals_the_expression(spark):
    work = spark.createDataFrame([("a", 0.0, 100.0, 0.5, 31.3, 0.125, False), ("b", 0.0, 0.1, 0.5, 31.3, 0.125, False)], "id string, a double, b double, ab_tol double, target double, tolerance double, inverse boolean")

    def measure(frames):
        for f in frames:
            yield f.assign(quality=20 + 0.25 * f["param"])[["id", "quality"]]

    got = {r["id"]: r for r in trials.target_search(work, measure, 10, lambda df, i: df).collect()}
    one = work.where("id = 'a'").select(trials.bisect(F.col("a"), F.col("b"), F.col("ab_tol"), F.col("target"), F.col("tolerance"), F.col("inverse"), lambda c: 20 + 0.25 * c, 10).alias("x")).first()["x"]
    assert (got["a"]["param"], got["a"]["status"]) == (one["param"], one["status"])
    assert got["b"]["status"] == "no_trial"


def test_extrema_labels_are_swapped_for_reductions(spark):
    rows = spark.createDataFrame([("420", "x", "m", 1.0, "a", 2.0, -10.0), ("420", "x", "m", 1.0, "b", 3.0, 5.0)], "sub_sampling string, codec string, target_metric string, target_value double, source string, compress_rate double, reduction double")
    assert {r["kind"]: (r["max"], r["min"]) for r in analysis.extrema(rows).collect()} == {"terse": (-10.0, 5.0), "cr": (3.0, 2.0)}


def test_decimals_are_those_of_the_binary_value(spark):
    rng = random.Random(1)
    values = [28.325, 0.125, 0.375, -12.665, 0.005, 1.005, -0.0, 2.675, 1e9 + 0.005, *(rng.randrange(-(10**7), 10**7) / 1000 for _ in range(3000))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", report.fixed(F.col("v"), 2).alias("t")).collect()
    assert all(float(r["t"]) == float(f"{r['v']:.2f}") for r in got)


def test_trials_decode_and_measure(spark):
    plan = spark.createDataFrame([("a", "zlib", 6, b"abc" * 50), ("b", "coarse", 2, bytes(range(256))), ("c", "none", 1, b"x"), ("d", "lzma", 1, None), ("e", "bz2", 9, b"")], "id string, codec string, param int, payload binary")
    got = {r["id"]: r for r in trials.run_trials(plan, trials.encode_decode_measure, trials.MEASURED_SCHEMA).collect()}
    assert got["a"]["sse"] == 0 and got["a"]["psnr"] == float("inf") and got["a"]["file_size_bytes"] < 150
    assert got["b"]["sse"] == 64 * (1 + 4 + 9) and abs(got["b"]["psnr"] - 10 * math.log10(65025 * 256 / 896)) < 1e-9
    assert got["c"]["status"] == got["d"]["status"] == "error" and got["c"]["psnr"] is None and got["e"]["status"] == "ok"


def test_frames_of_text_and_bytes(spark):
    text = spark.createDataFrame([(1, "\U0001f600b\ncdé"), (2, "a"), (3, None)], "id long, c string")
    got = files.fixed_frames(text, "id", "c", 2).orderBy("frame_no").collect()
    assert [(r["id"], r["frame_no"], r["frame"]) for r in got] == [(1, 0, "\U0001f600b"), (1, 1, "\nc"), (1, 2, "dé")]
    raw = files.fixed_frames(spark.createDataFrame([(1, b"abcde"), (2, b"")], "id long, c binary"), "id", "c", 2)
    assert [bytes(r["frame"]) for r in raw.orderBy("frame_no").collect()] == [b"ab", b"cd"]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.new_path(Session(), "x")
