"""Packed planes: a row holds the samples of some lines of a plane as bytes, so that video fits in rows and shuffles.

A tile is (image, plane, line, width, v, ...): the first line, the samples of a line, and samples as little-endian
unsigned integers of 8 or 16 bits, line by line. Errors, shifts and merges of fields are kernels over whole tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdlab.operators.digest import fold_digest
from rdlab.operators.pixels import _psnr

KINDS = {8: np.dtype("<u1"), 16: np.dtype("<u2")}


def _numbers(x: pa.Scalar, bits: int) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), KINDS[bits])


def _map(kernel: Callable[..., bytes | None], *columns: Column) -> Column:
    """binary: the kernel on each row's binary scalars; a row with a null has a null."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            arrays = arrays if isinstance(arrays, tuple) else (arrays,)
            yield pa.array([kernel(*row) if all(x.is_valid for x in row) else None for row in zip(*arrays, strict=True)], pa.binary())

    if len(columns) == 1:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from run(batches)

        return F.arrow_udf(one, "binary")(*columns)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from run(batches)

    return F.arrow_udf(several, "binary")(*columns)


def pack(samples: str | Column, bits: int = 16) -> Column:
    """binary: an array of numbers in the range of `bits` as samples."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if not x.is_valid else np.asarray(x.values).astype(KINDS[bits]).tobytes() for x in b], pa.binary())

    return F.arrow_udf(run, "binary")(F.col(samples) if isinstance(samples, str) else samples)


def errors(v: str | Column, w: str | Column, bits: int = 16) -> Column:
    """struct(samples, sse) of each tile: exact integers. Tiles of different lengths are an error; a null tile has a null."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for v, w in batches:
            n, sse, ok = [], [], []
            for a, b in zip(v, w, strict=True):
                ok.append(a.is_valid and b.is_valid)
                if ok[-1]:
                    x, y = (_numbers(t, bits).astype(np.int64) for t in (a, b))
                    if len(x) != len(y):
                        raise ValueError(f"tiles of {len(x)} and {len(y)} samples")
                    d = x - y
                    n.append(len(x))
                    sse.append(int(d @ d))
                else:
                    n.append(None)
                    sse.append(None)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(sse, pa.int64())], ["samples", "sse"], mask=pa.array([not x for x in ok]))

    column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.arrow_udf(run, "struct<samples:long,sse:long>")(column(v), column(w))


def plane_psnr(tiles: DataFrame, depth: int = 16, bits: int = 16, infinite: bool = False) -> DataFrame:
    """(image, plane, samples, sse, psnr) of samples v against w, kept in `depth` bits, with a peak of `bits` bits; a row for a tile is summed before the shuffle. Equal planes have a null PSNR, or Infinity."""
    equal = F.lit(float("inf")) if infinite else F.lit(None).cast("double")
    rows = tiles.select("image", "plane", errors("v", "w", depth).alias("e"))
    out = rows.groupBy("image", "plane").agg(F.sum("e.samples").alias("samples"), F.sum("e.sse").alias("sse"))
    return out.withColumn("psnr", _psnr(F.col("sse"), F.col("samples"), bits, equal))


def plane_mse(tiles: DataFrame, depth: int = 16) -> DataFrame:
    """Mean squared error of each plane, and of the whole image as plane ALL, in one pass."""
    rows = tiles.select("image", "plane", errors("v", "w", depth).alias("e")).select("image", "plane", F.col("e.samples").alias("n"), F.col("e.sse").alias("sse"))
    out = rows.groupingSets([["image", "plane"], ["image"]], "image", "plane").agg((F.sum("sse") / F.sum("n")).alias("mse"))
    return out.select("image", F.coalesce("plane", F.lit("ALL")).alias("plane"), "mse")


def depth_shift(tiles: DataFrame, shift: int, bits: int) -> DataFrame:
    """tiles at a lower bit depth, in samples as wide as before: v shifted down, w rounded and clipped."""
    kind, peak = KINDS[16 if bits > 8 else 8], (1 << (bits - shift)) - 1
    down = lambda x: (np.frombuffer(x.as_buffer(), kind) >> shift).astype(kind).tobytes()
    rounded = lambda x: np.clip((np.frombuffer(x.as_buffer(), kind).astype(np.int64) + (1 << (shift - 1))) >> shift, 0, peak).astype(kind).tobytes()
    return tiles.withColumns({"v": _map(down, F.col("v")), "w": _map(rounded, F.col("w"))})


def interleave(first: bytes, second: bytes, width: int, bits: int = 16) -> bytes:
    """The lines of two fields in turn, the first field's first; it may have one line more."""
    a, b = (np.frombuffer(x, KINDS[bits]).reshape(-1, width) for x in (first, second))
    if len(a) not in (len(b), len(b) + 1):
        raise ValueError(f"fields of {len(a)} and {len(b)} lines")
    out = np.empty((len(a) + len(b), width), KINDS[bits])
    out[0::2], out[1::2] = a, b
    return out.tobytes()


def field_merge(fields: DataFrame, bits: int = 16) -> DataFrame:
    """Frames from fields (image, field, block, width, w): of each block of lines the two fields' tiles become one of (image, block, width, w).

    Blocks must be cut alike: block k of either field has the rows that block k of the frame has as even and odd lines. A last block may have an odd
    number of lines, and no tile of field 1 at all if that is one line. Rows are tiles, so a shuffle moves packed lines and no key is a sample.
    """
    pick = lambda k: F.first(F.when(F.col("field") == k, F.col("w")), ignorenulls=True)
    pairs = fields.groupBy("image", "block").agg(F.max("width").alias("width"), pick(0).alias("a"), F.coalesce(pick(1), F.lit(b"")).alias("b"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b, width in batches:
            yield pa.array([interleave(x.as_buffer(), y.as_buffer(), w, bits) if x.is_valid else None for x, y, w in zip(a, b, width.to_pylist(), strict=True)], pa.binary())

    return pairs.select("image", "block", "width", F.arrow_udf(run, "binary")("a", "b", "width").alias("w"))


def field_merge_psnr(fields: DataFrame, frames: DataFrame, bits: int, depth: int = 16) -> DataFrame:
    """PSNR of each frame merged from two fields against the original tiles (image, block, v)."""
    both = field_merge(fields, depth).join(frames.select("image", "block", "v"), ["image", "block"])
    return plane_psnr(both.withColumn("plane", F.lit("Y")), depth, bits).select("image", "samples", "sse", "psnr")


def frame_digest(tiles: DataFrame, bits: int = 16) -> DataFrame:
    """MD5 over the samples of a frame, in the order of planes Y, U, V and lines, as decimal numbers with commas: as pixels.frame_digest of the samples."""
    rows = tiles.select("image", F.instr(F.lit("YUV"), F.col("plane")).alias("p"), "line", "v")
    return fold_digest(rows, ["p", "line"], lambda x: ",".join(map(str, _numbers(x, bits).tolist())).encode())
