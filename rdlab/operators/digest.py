"""Digests of frames as a fold over sorted rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold_digest(rows: DataFrame, order: list[str], text: Callable[[pa.Scalar], bytes]) -> DataFrame:
    """(image, digest): MD5 of the texts of an image's rows, joined by commas, in their order.

    Rows are sorted within partitions and folded as they come: the state is one hash, carried over Arrow batches, so an image of any size takes no
    more memory than a batch. All rows of an image go through one task, as MD5 has no parallel form. An image whose rows have no samples is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, state, some = None, None, False

        def done() -> Iterator[pa.RecordBatch]:
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([image], kind), pa.array([state.hexdigest()])], ["image", "digest"])

        for b in batches:
            kind = b.schema.field("image").type
            for now, v in zip(b.column("image").to_pylist(), b.column("v"), strict=True):
                if state is None or now != image:
                    yield from done()
                    image, state, some = now, hashlib.md5(usedforsecurity=False), False
                part = text(v) if v.is_valid else b""
                if part:
                    state.update(b"," + part if some else part)
                    some = True
        yield from done()

    kind = rows.schema["image"].dataType.simpleString()
    return rows.repartition("image").sortWithinPartitions("image", *order).select("image", "v").mapInArrow(run, f"image {kind}, digest string")
