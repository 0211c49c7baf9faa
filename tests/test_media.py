"""Raw sequences, packed planes, digests and running sums."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rdlab.operators import digest, pixels, prefix, tiles
from rdlab.sources import raw


def test_frames_by_ranges_leave_out_rests(spark, tmp_path):
    whole = bytes(range(256)) * 4
    rows = [("whole", bytearray(whole)), ("rest", bytearray(whole[:35])), ("empty", bytearray()), ("short", bytearray(b"xyz")), ("null", None), ("a b%+ü", bytearray(whole[:20]))]
    raw.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "raw"))
    got = raw.read_frames(spark, str(tmp_path / "raw"), 10, range_bytes=30, partition_bytes=60)
    assert got.rdd.getNumPartitions() > 10
    found = {}
    for r in got.collect():
        found.setdefault(r["name"], {})[r["frame_no"]] = bytes(r["frame"])
    want = {"whole": 102, "rest": 3, "a b%+ü": 2}
    assert {k: sorted(v) for k, v in found.items()} == {k: list(range(n)) for k, n in want.items()}
    assert all(v[i] == whole[10 * i : 10 * i + 10] for v in found.values() for i in v)


def test_frames_beyond_two_gigabytes(spark, tmp_path):
    path = tmp_path / "big.yuv"
    with path.open("wb") as f:  # sparse: no disk is taken
        f.truncate(5 << 30)
        f.seek(3 << 30)
        f.write(b"hello")
    got = raw.read_frames(spark, str(path), 1 << 20, first=3071, count=3).select("frame_no", F.length("frame").alias("n"), F.substring("frame", 1, 5).alias("head")).collect()
    assert [(r["frame_no"], r["n"], bytes(r["head"]) == b"hello") for r in got] == [(3071, 1 << 20, False), (3072, 1 << 20, True), (3073, 1 << 20, False)]


def test_frames_need_a_size(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"12345")
    with pytest.raises(Exception, match="size"):
        spark.dataSource.register(raw.RawFrames)
        spark.read.format("rawframes").load(str(tmp_path)).count()
    assert raw.read_frames(spark, str(tmp_path), 6).count() == 0
    assert raw.read_frames(spark, str(tmp_path), 5, first=1).count() == 0


def _samples(spark, bits, height, width, images=3, seed=1):
    draw = random.Random(seed)
    rows = []
    for image in range(images):
        for plane in "YUV":
            for at in range(height * width):
                v = draw.randrange(1 << bits)
                rows.append((image, plane, at, v, min(max(v + draw.randint(-5, 5), 0), (1 << bits) - 1)))
    return rows, spark.createDataFrame(rows, "image int, plane string, idx int, v long, w long")


def _tiles(spark, rows, width, lines, bits):
    """Tiles of `lines` lines, the last of a plane shorter."""
    kind, planes = tiles.KINDS[bits], {}
    for image, plane, _, v, w in rows:
        planes.setdefault((image, plane), []).append((v, w))
    out = []
    for (image, plane), vw in planes.items():
        for line in range(0, len(vw) // width, lines):
            part = np.array(vw[line * width : (line + lines) * width])
            out.append((image, plane, line, width, bytearray(part[:, 0].astype(kind).tobytes()), bytearray(part[:, 1].astype(kind).tobytes())))
    return spark.createDataFrame(out, "image int, plane string, line int, width int, v binary, w binary")


@pytest.mark.parametrize(("bits", "height", "lines"), [(8, 7, 2), (16, 5, 3), (16, 1, 4)])
def test_tiles_measure_as_samples_do(spark, bits, height, lines):
    rows, samples = _samples(spark, bits, height, 6)
    packed = _tiles(spark, rows, 6, lines, bits)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(tiles.plane_psnr(packed, depth=bits, bits=bits)) == key(pixels.plane_psnr(samples, bits))
    assert key(tiles.plane_mse(packed, bits)) == key(pixels.plane_mse(samples))
    down = 4 if bits == 16 else 2
    assert key(tiles.plane_psnr(tiles.depth_shift(packed, down, bits), depth=bits, bits=bits - down)) == key(pixels.plane_psnr(pixels.depth_shift(samples, down, bits), bits - down))
    assert key(tiles.frame_digest(packed, bits)) == key(pixels.frame_digest(samples))
    want = {image: hashlib.md5(",".join(str(v) for i, _, _, v, _ in rows if i == image).encode(), usedforsecurity=False).hexdigest() for image in range(3)}
    assert {r["image"]: r["digest"] for r in tiles.frame_digest(packed, bits).collect()} == want


def test_tiles_of_nulls_and_other_lengths(spark):
    rows = spark.createDataFrame([(1, "Y", bytearray(b"ab"), bytearray(b"ab")), (1, "Y", None, bytearray(b"ab"))], "image int, plane string, v binary, w binary")
    assert [tuple(r) for r in tiles.plane_psnr(rows, 8, 8).collect()] == [(1, "Y", 2, 0, None)]
    assert tiles.plane_psnr(rows, 8, 8, infinite=True).first()["psnr"] == math.inf
    assert tiles.plane_psnr(rows.limit(0), 8, 8).isEmpty()
    bad = spark.createDataFrame([(1, "Y", bytearray(b"ab"), bytearray(b"a"))], "image int, plane string, v binary, w binary")
    with pytest.raises(Exception, match="2 and 1 samples"):
        tiles.plane_psnr(bad, 8, 8).collect()


@pytest.mark.parametrize("height", [6, 7, 9])
def test_fields_of_odd_heights_merge(spark, height):
    width, block = 3, 4
    frame = np.arange(height * width, dtype="<u2").reshape(height, width) * 1000 % 65521
    other = frame ^ 5
    fields, frames = [], []
    for b in range(0, height, block):
        lines, seen = frame[b : b + block].astype("<u2"), other[b : b + block].astype("<u2")
        frames.append((1, b // block, bytearray(lines.tobytes())))
        fields += [(1, b // block, k, width, bytearray(seen[k::2].tobytes())) for k in (0, 1) if len(seen[k::2])]
    fields = spark.createDataFrame(fields, "image int, block int, field int, width int, w binary")
    frames = spark.createDataFrame(frames, "image int, block int, v binary")
    merged = b"".join(bytes(r["w"]) for r in tiles.field_merge(fields).orderBy("block").collect())
    assert merged == other.astype("<u2").tobytes()
    got = tiles.field_merge_psnr(fields, frames, 16).first()
    assert (got["samples"], got["sse"]) == (height * width, int(((frame.astype(int) - other.astype(int)) ** 2).sum()))


def test_no_sample_is_exchanged(spark):
    rows, _ = _samples(spark, 8, 4, 4)
    plan = tiles.plane_psnr(_tiles(spark, rows, 4, 2, 8), 8, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "partial_sum" in plan


def test_a_digest_runs_over_many_batches(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit(7).alias("image"), F.lit("Y").alias("plane"), F.col("id").alias("idx"), (F.col("id") * 7 % 251).alias("v")).repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = pixels.frame_digest(rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r["image"], r["digest"]) for r in got] == [(7, hashlib.md5(",".join(str(i * 7 % 251) for i in range(n)).encode(), usedforsecurity=False).hexdigest())]
    assert digest.fold_digest(rows.select("image", "idx", F.lit(None).cast("string").alias("v")), ["idx"], lambda x: x.as_py().encode()).isEmpty()


def test_running_sums_cross_blocks(spark):
    n = 2000
    rows = spark.range(n).select((F.col("id") % 3 == 0).cast("int").alias("seq"), (F.col("id") * 3).alias("frame"), F.when(F.col("id") % 11 != 0, (F.col("id") % 17).cast("double")).alias("psnr"), F.lit("x").alias("__x"))
    got = {(r["seq"], r["frame"]): (r["psnr"], r["running"]) for r in pixels.sequence_psnr(rows, block=100).collect()}
    assert len(got) == n
    for seq in (0, 1):
        total = many = 0
        for (_, _), (psnr, running) in sorted((k, v) for k, v in got.items() if k[0] == seq):
            if psnr is not None:
                total, many = total + psnr, many + 1
            assert running == (pytest.approx(total / many) if many else None)
    # a sequence is in many tasks: far more groups than sequences
    parts = rows.groupBy("seq", F.floor(F.col("frame") / 100)).count().count()
    assert parts >= 8 * 2
    plan = prefix.running(rows, {"s": F.col("psnr")}, 100)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(seq" in plan.replace("seq#", "seq") or "__block" in plan


def test_bits_rise_across_blocks(spark):
    rows = [(s, f, "IPB"[f % 3], sum(range(f + 1)) * (s + 1), f % 2) for s in range(2) for f in range(0, 500, 1)]
    counters = spark.createDataFrame(rows, "seq int, frame int, kind string, counter long, duplicate long")
    got = {(r["seq"], r["frame"]): r["bits"] for r in pixels.frame_bits(counters, block=7).collect()}
    assert got == {(s, f): f * (s + 1) for s in range(2) for f in range(500)}
    by = {r["seq"]: (r["i_bits"], r["p_bits"], r["b_bits"], r["frames"]) for r in pixels.bits_by_type(counters, block=7).collect()}
    assert by[0] == (sum(range(0, 500, 3)), sum(range(1, 500, 3)), sum(range(2, 500, 3)), 500)
    assert pixels.frame_bits(counters.limit(0)).isEmpty()
