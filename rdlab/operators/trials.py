"""Running trials, searching a parameter for a target, and the figures of a trial."""

from __future__ import annotations

import bz2
import lzma
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trial_rates(df: DataFrame, frames: Column | None = None, depth: Column | None = None) -> DataFrame:
    """df with source_file_size, bpp and compress_rate from width, height, frames, depth and file_size_bytes; one channel."""
    frames = F.col("frames") if frames is None else frames
    depth = F.col("depth") if depth is None else depth
    pixels = F.col("width").cast("double") * F.col("height") * frames
    return df.withColumns({
        "source_file_size": pixels * depth / 8,
        "bpp": F.col("file_size_bytes") * 8 / pixels,
        "compress_rate": F.try_divide(pixels * depth / 8, F.col("file_size_bytes")),
    })


def rate_from_pixels(size: Column, pixels: Column) -> Column:
    return size * 8 / pixels


def search_budget(width: Column, tolerance: Column) -> Column:
    """The most trials of a search: the smallest k with width / 2^k <= tolerance; 0 for a range without width or already as narrow."""
    return F.when((width <= 0) | (tolerance <= 0) | (width <= tolerance), 0).otherwise(F.ceil(F.log2(width / tolerance))).cast("int")


def bisect(low: Column, high: Column, width: Column, target: Column, tolerance: Column, inverse: Column, quality: Callable[[Column], Column], rounds: int) -> Column:
    """struct(param, quality, trials, status) of a bisection whose quality is an expression of the parameter; one pass, no shuffle.

    A trial takes the middle of the range while the range is wider than `width`; it ends with a hit where the quality is
    within the tolerance. Otherwise the last trial counts: status exhausted, or no_trial if none was made.
    """
    start = F.struct(low.cast("double").alias("a"), high.cast("double").alias("b"), F.lit(None).cast("double").alias("param"), F.lit(None).cast("double").alias("quality"), F.lit(0).alias("trials"), F.lit(False).alias("hit"))

    def step(s: Column, _: Column) -> Column:
        c = (s["a"] + s["b"]) / 2
        q = quality(c)
        go = ~s["hit"] & (s["b"] - s["a"] > width)
        up = (q < target) != inverse
        return F.struct(
            F.when(go & up, c).otherwise(s["a"]).alias("a"), F.when(go & ~up, c).otherwise(s["b"]).alias("b"),
            F.when(go, c).otherwise(s["param"]).alias("param"), F.when(go, q).otherwise(s["quality"]).alias("quality"),
            (s["trials"] + go.cast("int")).alias("trials"), (s["hit"] | (go & (F.abs(q - target) < tolerance))).alias("hit"),
        )

    def done(s: Column) -> Column:
        return F.struct(s["param"].alias("param"), s["quality"].alias("quality"), s["trials"].alias("trials"), F.when(s["hit"], "hit").when(s["trials"] > 0, "exhausted").otherwise("no_trial").alias("status"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, done)


def target_search(work: DataFrame, measure: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], rounds: int, keep: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The same search where quality comes from a function over partitions, round by round.

    work: id, a, b, ab_tol, target, tolerance, inverse. measure gets (id, param) frames and yields (id, quality). keep stores a
    round's table where all executors can read it. Only rows still searching are measured.
    """
    empty = {"param": F.lit(None).cast("double"), "quality": F.lit(None).cast("double"), "trials": F.lit(0), "hit": F.lit(False)}
    state = keep(work.withColumns(empty), 0)
    for i in range(1, rounds + 1):
        active = state.where((~F.col("hit")) & (F.col("b") - F.col("a") > F.col("ab_tol"))).withColumn("c", (F.col("a") + F.col("b")) / 2)
        if active.isEmpty():
            break
        got = active.select("id", F.col("c").alias("param")).mapInPandas(measure, "id string, quality double").withColumnRenamed("quality", "q")
        tried = active.join(got, "id", "left")
        up = (F.col("q") < F.col("target")) != F.col("inverse")
        moved = tried.select(
            "id", F.when(up, F.col("c")).otherwise(F.col("a")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("c")).alias("b"), "ab_tol", "target", "tolerance", "inverse",
            F.col("c").alias("param"), F.col("q").alias("quality"), (F.col("trials") + 1).alias("trials"), F.coalesce(F.abs(F.col("q") - F.col("target")) < F.col("tolerance"), F.lit(False)).alias("hit"),
        )
        rest = state.where(F.col("hit") | (F.col("b") - F.col("a") <= F.col("ab_tol")))
        state = keep(rest.select(*moved.columns).union(moved), i)
    return state.select("id", "target", "param", "quality", "trials", F.when(F.col("hit"), "hit").when(F.col("trials") > 0, "exhausted").otherwise("no_trial").alias("status"))


def search_measured(wanted: DataFrame, low: int, high: int, measure: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], join: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, str], DataFrame], inverse: bool = True) -> DataFrame:
    """(id, target, param, quality, trials, status): of the whole parameters low to high the one whose measured quality is nearest to each target, by bisection with real trials.

    Of equally near ones a quality that reaches the target wins, then the parameter next to where quality crosses the target.

    Payloads stay in place: join gives each row of (id, param) its payload, shuffling only those narrow rows. wanted: (id, target). All targets of an id share
    the trials of a round: a parameter is encoded, decoded and measured once, by measure as in run_trials, with columns id, param, psnr and status.
    Quality must not rise with the parameter if inverse, or not fall if not; an infinite quality is above any target. A failed trial, or an id without
    payload, ends its search with status error; otherwise it is hit (found) or no_trial for an empty range. keep writes a round's brackets; no payload is in them.
    """
    state = wanted.select("id", F.col("target").cast("double").alias("target"), F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(None).cast("int").alias("param"), F.lit(None).cast("double").alias("quality"), F.lit(0).alias("trials"), F.lit(False).alias("failed"))
    state = keep(state, "bracket0")
    rounds = max(0, high - low + 1).bit_length()
    for i in range(1, rounds + 1):
        open_ = ~F.col("failed") & (F.col("lo") <= F.col("hi"))
        middle = state.withColumn("c", F.when(open_, F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")))
        tries = middle.where("c is not null").select("id", F.col("c").alias("param")).distinct()
        got = join(tries).mapInPandas(measure, MEASURED_SCHEMA).select(F.col("id").alias("__id"), F.col("param").alias("__c"), F.when(F.col("status") == "ok", F.col("psnr")).alias("q"))
        got = keep(got, f"measured{i}")
        tried = middle.join(got, (F.col("id") == F.col("__id")) & (F.col("c") == F.col("__c")), "left")
        q, c, moved = F.col("q"), F.col("c"), F.col("c").isNotNull()
        on = (q >= F.col("target")) if inverse else (q < F.col("target"))  # the wanted parameter is not below c
        far = lambda x: F.abs(x - F.col("target"))
        reached, had, higher = q >= F.col("target"), F.col("quality") >= F.col("target"), (c > F.col("param")) if inverse else (c < F.col("param"))
        tie = (far(q) == far(F.col("quality"))) & F.when(reached, ~had | higher).otherwise(~had & ~higher)
        better = q.isNotNull() & (F.col("quality").isNull() | (far(q) < far(F.col("quality"))) | tie)
        state = keep(
            tried.select(
                "id", "target", F.when(moved & on, c + 1).otherwise(F.col("lo")).alias("lo"), F.when(moved & ~on, c - 1).otherwise(F.col("hi")).alias("hi"),
                F.when(moved & better, c).otherwise(F.col("param")).alias("param"), F.when(moved & better, q).otherwise(F.col("quality")).alias("quality"),
                (F.col("trials") + moved.cast("int")).alias("trials"), (F.col("failed") | (moved & q.isNull())).alias("failed"),
            ),
            f"bracket{i}",
        )
    status = F.when(F.col("failed"), "error").when(F.col("trials") > 0, "hit").otherwise("no_trial")
    return state.select("id", "target", F.when(~F.col("failed"), F.col("param")).alias("param"), F.when(~F.col("failed"), F.col("quality")).alias("quality"), "trials", status.alias("status"))


def target_pick(encodes: DataFrame, metric: str, target: float, tolerance: float) -> DataFrame:
    """Of measured trials the one nearest to the target, per source, codec and subsampling; ties to the smaller parameter."""
    order = Window.partitionBy("sub_sampling", "codec", "source").orderBy(F.abs(F.col(metric) - target), "codec_param", "id")
    rows = encodes.withColumn("n", F.row_number().over(order)).where("n = 1")
    return rows.select("sub_sampling", "codec", "source", "codec_param", F.col(metric).alias("quality"), (F.abs(F.col(metric) - target) < tolerance).alias("inside"))


PACKERS = {"zlib": lambda data, level: zlib.compress(data, level), "bz2": lambda data, level: bz2.compress(data, max(1, level)), "lzma": lambda data, level: lzma.compress(data, preset=level)}
RUN_SCHEMA = "id string, codec string, param int, source_bytes long, file_size_bytes long, status string, error string"


def pack_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The built-in trial function: lossless packing of payloads by zlib, bz2 or lzma; a failure becomes a row."""
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            try:
                out.append((r.id, r.codec, r.param, len(r.payload), len(PACKERS[r.codec](r.payload, r.param)), "ok", None))
            except Exception as e:  # any failure of a trial is its result
                out.append((r.id, r.codec, r.param, None if r.payload is None else len(r.payload), None, "error", repr(e)[:200]))
        yield pd.DataFrame(out, columns=["id", "codec", "param", "source_bytes", "file_size_bytes", "status", "error"]).astype({"source_bytes": "Int64", "file_size_bytes": "Int64"})


def _keep_high(data: bytes, bits: int) -> bytes:
    """Lossy: the low bits of each byte are dropped, the rest is packed."""
    return zlib.compress((np.frombuffer(data, np.uint8) >> bits << bits).tobytes())


#: The built-in codecs: encode(data, param) and decode(data).
CODECS = {"zlib": (PACKERS["zlib"], zlib.decompress), "bz2": (PACKERS["bz2"], bz2.decompress), "lzma": (PACKERS["lzma"], lzma.decompress), "coarse": (_keep_high, zlib.decompress)}
MEASURED_SCHEMA = "id string, codec string, param int, source_bytes long, file_size_bytes long, sse long, psnr double, status string, error string"


def encode_decode_measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A trial function that encodes a payload, decodes it and measures the bytes against the source: sse, and psnr in dB (infinite where they are equal).

    A failure of any step, or a result of another length, becomes a row of status error.
    """
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            size = None if r.payload is None else len(r.payload)
            try:
                encode, decode = CODECS[r.codec]
                packed = encode(r.payload, r.param)
                a, b = (np.frombuffer(x, np.uint8) for x in (r.payload, decode(packed)))
                if len(a) != len(b):
                    raise ValueError(f"{len(b)} bytes decoded")
                gap = a.astype(np.float64)
                gap -= b
                sse = int(np.dot(gap, gap))  # whole numbers, exact below 2^53: up to 138 GB
                out.append((r.id, r.codec, r.param, size, len(packed), sse, 10 * math.log10(255 * 255 * size / sse) if sse else math.inf, "ok", None))
            except Exception as e:  # any failure of a trial is its result
                out.append((r.id, r.codec, r.param, size, None, None, None, "error", repr(e)[:200]))
        names = [x.split()[0] for x in MEASURED_SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"source_bytes": "Int64", "file_size_bytes": "Int64", "sse": "Int64", "psnr": "float64"})


def run_trials(grid: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] = pack_bytes, schema: str = RUN_SCHEMA, partitions: int | None = None) -> DataFrame:
    """Apply a trial function to each planned trial over partitions dealt by id, as costs differ between codecs."""
    dealt = grid.repartition(partitions, "id") if partitions else grid.repartition("id")
    return dealt.mapInPandas(fn, schema)
