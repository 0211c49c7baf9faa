"""Bjontegaard-delta rates: curves, their checks, and the areas between them.

A curve is one array of (rate, quality) points. One shuffle by (sub_sampling, metric, source) brings together the curves of
all codecs, the baseline's among them; all later steps are expressions on arrays and one window over the same keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rdlab.schema import BD_METRICS

NO_OVERLAP = -10000.0
MIN_POINTS = 4
CURVE = ["sub_sampling", "metric", "codec", "source"]
PAIR = ["sub_sampling", "metric", "source"]


def rd_points(encodes: DataFrame, total_pixels: Column | None = None, metrics: tuple[str, ...] = BD_METRICS) -> DataFrame:
    """One point per trial: rate in bits per pixel and the quality metrics; all targets."""
    pixels = F.col("width") * F.col("height") if total_pixels is None else total_pixels
    return encodes.select("sub_sampling", "codec", "source", "target_metric", "target_value", (F.col("file_size_bytes") * 8 / pixels).alias("rate"), *metrics)


def rd_points_long(points: DataFrame, metrics: tuple[str, ...] = BD_METRICS) -> DataFrame:
    """One row per point and metric."""
    return points.select("sub_sampling", "codec", "source", "rate", *metrics).unpivot(["sub_sampling", "codec", "source", "rate"], list(metrics), "metric", "quality")


def pair_rule(df: DataFrame) -> DataFrame:
    """Leave out webp with 444, which the codec doesn't have."""
    return df.where(~((F.col("codec") == "webp") & (F.col("sub_sampling") == "444")))


def curves(long: DataFrame) -> DataFrame:
    """Distinct points of each curve as an array sorted by rate, then quality."""
    return long.groupBy(*CURVE).agg(F.sort_array(F.collect_set(F.struct("rate", "quality"))).alias("points"))


def ordered_points(long: DataFrame) -> DataFrame:
    """Distinct points with their place (seq from 1) on the curve."""
    points = curves(long).select(*CURVE, F.posexplode("points").alias("at", "p"))
    return points.select(*CURVE, (F.col("at") + 1).alias("seq"), "p.rate", "p.quality")


def _steps(points: Column) -> Column:
    return F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def checked(curve: DataFrame) -> DataFrame:
    """curves() with n_points, enough, monotonic (both coordinates rise strictly) and rates_ok (no zero rate)."""
    p = F.col("points")
    rising = F.forall(_steps(p), lambda s: (s["a"]["rate"] < s["b"]["rate"]) & (s["a"]["quality"] < s["b"]["quality"]))
    return curve.select("*", F.size(p).alias("n_points"), (F.size(p) >= MIN_POINTS).alias("enough"), rising.alias("monotonic"), F.forall(p, lambda x: x["rate"] != 0).alias("rates_ok"))


def _end_slope(h1: Column, h2: Column, d1: Column, d2: Column) -> Column:
    e = ((2 * h1 + h2) * d1 - h1 * d2) / (h1 + h2)
    return F.when(e * d1 < 0, F.lit(0.0)).when((d1 * d2 < 0) & (F.abs(e) > F.abs(3 * d1)), 3 * d1).otherwise(e)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _logs(rates: pa.Array) -> pa.Array:
    """log10 of each rate by the C library, null where there is none. Java's may differ in the last bit, which cubic terms that nearly cancel make large."""
    flat = rates.flatten()
    coded = flat.dictionary_encode()
    logs = pa.array([math.log10(x) if x is not None and x > 0 else None for x in coded.dictionary.to_pylist()], pa.float64())
    ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(rates), 0).to_numpy(zero_copy_only=False))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), logs.take(coded.indices), mask=rates.is_null() if rates.null_count else None)


def _pieces(points: Column, logs: Column) -> Column:
    """The steps (x, y, h, delta) of log10(rate) over quality; nulls where a curve can't have them."""
    return F.transform(
        _steps(points),
        lambda s, i: F.struct(
            s["a"]["quality"].alias("x"), F.get(logs, i).alias("y"), (s["b"]["quality"] - s["a"]["quality"]).alias("h"),
            F.try_divide(F.get(logs, i + 1) - F.get(logs, i), s["b"]["quality"] - s["a"]["quality"]).alias("delta"),
        ),
    )


def pchip(valid: DataFrame) -> DataFrame:
    """Curves with good (they passed their checks) and parts: for the good ones an array of (x, y, h, delta, d, c, b), the cubic pieces of the monotone interpolation."""
    points = F.when(F.col("good"), F.col("points"))
    with_steps = valid.withColumn("logs", _logs(F.transform(points, lambda p: p["rate"]))).withColumn("steps", _pieces(points, F.col("logs")))
    s, n = F.col("steps"), F.size("steps")
    first = _end_slope(s[0]["h"], s[1]["h"], s[0]["delta"], s[1]["delta"])
    last = _end_slope(F.get(s, n - 1)["h"], F.get(s, n - 2)["h"], F.get(s, n - 1)["delta"], F.get(s, n - 2)["delta"])

    def inner(a: Column, b: Column) -> Column:
        return (3 * a["h"] + 3 * b["h"]) / ((2 * b["h"] + a["h"]) / a["delta"] + (b["h"] + 2 * a["h"]) / b["delta"])

    mid = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), inner)
    sloped = with_steps.withColumn("slopes", F.concat(F.array(first), mid, F.array(last)))
    d = F.col("slopes")
    parts = F.transform(
        s,
        lambda p, i: F.struct(
            p["x"].alias("x"), p["y"].alias("y"), p["h"].alias("h"), p["delta"].alias("delta"), F.get(d, i).alias("d"),
            ((3 * p["delta"] - 2 * F.get(d, i) - F.get(d, i + 1)) / p["h"]).alias("c"),
            ((F.get(d, i) - 2 * p["delta"] + F.get(d, i + 1)) / (p["h"] * p["h"])).alias("b"),
        ),
    )
    return sloped.withColumn("parts", parts).drop("logs", "steps", "slopes")


def clipped_integral(parts: Column, lo: Column, hi: Column) -> Column:
    """The integral of the pieces between two qualities."""

    def one(p: Column) -> Column:
        s0 = F.least(F.greatest(p["x"], lo), hi) - p["x"]
        s1 = F.least(F.greatest(p["x"] + p["h"], lo), hi) - p["x"]
        area = (s1 - s0) * p["y"] + (s1 * s1 - s0 * s0) * p["d"] / 2 + (s1 * s1 * s1 - s0 * s0 * s0) * p["c"] / 3 + (s1 * s1 * s1 * s1 - s0 * s0 * s0 * s0) * p["b"] / 4
        return F.when(s1 > s0, area).otherwise(F.lit(0.0))

    return F.aggregate(parts, F.lit(0.0), lambda total, p: total + one(p))


def paired(long: DataFrame, baseline: str = "jpeg") -> DataFrame:
    """Each curve beside the baseline's of its (sub_sampling, metric, source): fit (both pass the checks), lo and hi of the common qualities, cubic pieces of both.

    A curve without a baseline curve is kept and isn't fit.
    """
    all_curves = checked(curves(long.repartition(*PAIR)))
    shaped = pchip(all_curves.withColumn("good", F.col("enough") & F.col("monotonic") & F.col("rates_ok")))
    ends = shaped.select(*CURVE, "good", "parts", F.element_at("points", 1)["quality"].alias("q0"), F.element_at("points", -1)["quality"].alias("q1"))
    known = F.col("source").isNotNull() & F.col("sub_sampling").isNotNull() & F.col("metric").isNotNull()
    base = F.first(F.when(known & (F.col("codec") == baseline), F.struct("good", "parts", "q0", "q1")), ignorenulls=True).over(Window.partitionBy(*PAIR))
    both = ends.withColumn("base", base)
    fit = F.coalesce(F.col("good") & F.col("base.good"), F.lit(False))
    return both.select(*CURVE, fit.alias("fit"), F.when(fit, F.greatest("q0", "base.q0")).alias("lo"), F.when(fit, F.least("q1", "base.q1")).alias("hi"), "parts", F.col("base.parts").alias("base_parts"))


def slopes(h: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Slopes of the monotone interpolation at all points of curves of one length: harmonic means inside, one-sided at the ends."""

    def end(h1: np.ndarray, h2: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        e = ((2 * h1 + h2) * d1 - h1 * d2) / (h1 + h2)
        return np.where(e * d1 < 0, 0.0, np.where((d1 * d2 < 0) & (np.abs(e) > np.abs(3 * d1)), 3 * d1, e))

    h1, h2, d1, d2 = h[:, :-1], h[:, 1:], delta[:, :-1], delta[:, 1:]
    inner = (3 * h1 + 3 * h2) / ((2 * h2 + h1) / d1 + (h2 + 2 * h1) / d2)
    return np.c_[end(h[:, 0], h[:, 1], delta[:, 0], delta[:, 1]), inner, end(h[:, -1], h[:, -2], delta[:, -1], delta[:, -2])]


def areas(rate: np.ndarray, quality: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The integrals of log10(rate) over quality from lo to hi, of curves of one length (a row each)."""
    y, h = np.log10(rate), np.diff(quality)
    delta = np.diff(y) / h
    d = slopes(h, delta)
    c, b = (3 * delta - 2 * d[:, :-1] - d[:, 1:]) / h, (d[:, :-1] - 2 * delta + d[:, 1:]) / (h * h)
    x = quality[:, :-1]
    s0, s1 = (np.clip(t, lo[:, None], hi[:, None]) - x for t in (x, x + h))
    area = (s1 - s0) * y[:, :-1] + (s1**2 - s0**2) * d[:, :-1] / 2 + (s1**3 - s0**3) * c / 3 + (s1**4 - s0**4) * b / 4
    return np.where(s1 > s0, area, 0.0).sum(1)


class _Curves:
    """Curves of a batch as flat arrays; those of one length are handled together."""

    def __init__(self, points: pa.ListArray):
        at = points.offsets.to_numpy().astype(np.int64)
        self.start, self.size = at[:-1], np.where(np.asarray(points.is_valid()), np.diff(at), 0)
        flat = points.values
        self.rate, self.quality = (pc.fill_null(flat.field(k), np.nan).to_numpy(zero_copy_only=False) for k in ("rate", "quality"))

    def groups(self, among: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for n in np.unique(self.size[among]):
            rows = np.flatnonzero(among & (self.size == n))
            at = self.start[rows][:, None] + np.arange(n)
            yield rows, self.rate[at], self.quality[at]

    def good(self) -> np.ndarray:
        """Enough points, both coordinates rising strictly, no rate of 0."""
        out = np.zeros(len(self.size), bool)
        for rows, rate, quality in self.groups(self.size >= MIN_POINTS):
            out[rows] = (np.diff(rate) > 0).all(1) & (np.diff(quality) > 0).all(1) & (rate != 0).all(1)
        return out

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        some = self.size > 0
        first, last = np.full(len(some), np.nan), np.full(len(some), np.nan)
        first[some], last[some] = self.quality[self.start[some]], self.quality[(self.start + self.size - 1)[some]]
        return first, last

    def areas(self, among: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size))
        for rows, rate, quality in self.groups(among):
            out[rows] = areas(rate, quality, lo[rows], hi[rows])
        return out


def _gaps(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """struct(fit, meet, gap) of each pair of curves: both pass their checks, their qualities overlap, and the mean difference of log10(rate)."""
    for points, base in batches:
        a, b = _Curves(points), _Curves(base)
        fit = a.good() & b.good()
        (a0, a1), (b0, b1) = a.ends(), b.ends()
        lo, hi = np.maximum(a0, b0), np.minimum(a1, b1)
        meet = fit & (lo < hi)
        with np.errstate(all="ignore"):
            gap = (a.areas(meet, lo, hi) - b.areas(meet, lo, hi)) / (hi - lo)
        yield pa.StructArray.from_arrays([pa.array(fit), pa.array(meet), pa.array(gap, pa.float64(), mask=~meet)], ["fit", "meet", "gap"])


def bd_rate(long: DataFrame, baseline: str = "jpeg", strict: bool = False) -> DataFrame:
    """(sub_sampling, metric, codec, source, status, bd_rate, out), bd_rate in percent, negative where the codec needs fewer bits.

    status: ok; exception where a curve fails its checks, or its baseline's (bd_rate null); no_overlap where the qualities don't meet, with
    100 * NO_OVERLAP as bd_rate, which enters means as a number unless strict. out: some codec's status of this source is exception.
    One shuffle brings the curves of a source together; the areas are one kernel over Arrow batches of pairs of curves.
    """
    all_curves = curves(long.repartition(*PAIR))
    pair = Window.partitionBy(*PAIR)
    known = F.col("source").isNotNull() & F.col("sub_sampling").isNotNull() & F.col("metric").isNotNull()
    base = F.first(F.when(known & (F.col("codec") == baseline), F.col("points")), ignorenulls=True).over(pair)
    p = all_curves.select(*CURVE, "points", base.alias("base")).select(*CURVE, F.arrow_udf(_gaps, "struct<fit:boolean,meet:boolean,gap:double>")("points", "base").alias("x"))
    status = F.when(~F.col("x.fit"), "exception").when(~F.col("x.meet"), "no_overlap").otherwise("ok")
    value = F.when(status == "ok", 100 * (F.pow(F.lit(10.0), F.col("x.gap")) - 1))
    value = value if strict else value.when(status == "no_overlap", F.lit(100 * NO_OVERLAP))
    out = F.max(~F.col("x.fit")).over(pair)
    return p.select(*CURVE, status.alias("status"), value.alias("bd_rate"), out.alias("out"))


def blacklist(rates: DataFrame) -> DataFrame:
    """(sub_sampling, metric, source) where any codec failed: the source is left out for all codecs."""
    return rates.where("status = 'exception'").select("sub_sampling", "metric", "source").distinct()


def blacklist_lines(rates: DataFrame) -> DataFrame:
    """(sub_sampling, metric, line): the blacklisted sources of a metric, in order; no line where there are none."""
    sources = F.array_join(F.array_sort(F.collect_set("source")), ", ")
    line = F.concat(F.rpad("sub_sampling", 5, " "), F.lit(" black list "), F.rpad(F.upper("metric"), 8, " "), F.lit(" BD RATE "), "sources")
    return blacklist(rates).groupBy("sub_sampling", "metric").agg(sources.alias("sources")).select("sub_sampling", "metric", line.alias("line"))


def bd_mean(rates: DataFrame, strict: bool = False) -> DataFrame:
    """Mean per (sub_sampling, metric, codec) over the sources not on the blacklist (column out of bd_rate); null if none is left."""
    use = ~F.col("out") & (F.col("status") == "ok" if strict else F.lit(True))
    return rates.groupBy("sub_sampling", "metric", "codec").agg(F.avg(F.when(use, F.col("bd_rate"))).alias("bd_rate"), F.count(F.when(use, 1)).alias("sources"))


def bd_matrix(means: DataFrame, metrics: tuple[str, ...] = BD_METRICS) -> DataFrame:
    """One row per (sub_sampling, codec), one column per metric."""
    return means.groupBy("sub_sampling", "codec").pivot("metric", list(metrics)).agg(F.first("bd_rate"))
