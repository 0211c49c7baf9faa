"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key, n_docs), bucketed and sorted by key, as many buckets as the session has shuffle partitions. A
batch of documents first merge-anti-joins the runs' settled keys (found in enough documents by the sum of all runs), then
adds its own counts as a run of level 0. When a level has `fanout` runs they are merged into one run of the next level.
A batch is shuffled into the buckets once and merges with one run after the other, bucket by bucket; merges of runs
meet in the same way: what runs hold is not shuffled. (Where more than two meet, the sums of the first ones are.)
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rdlab.llm.common import new_path, remove, written

_digest = xxhash.xxh3_128_digest


def _key(line: bytes, least: int) -> bytes | None:
    """16 bytes for the stripped, A-Z lower-cased line; None if it has under `least` code points. bytes.strip and bytes.lower know ASCII only."""
    line = line.strip(b" \t\n\v\f\r").lower()
    if len(line) < least or least > 1 and len(line.decode()) < least:
        return None
    return _digest(line)


class LineRuns:
    """Levelled runs of line keys: bucketed tables of the catalog with files in the shared folder."""

    SCHEMA = "key binary, n_docs bigint"

    def __init__(self, spark: SparkSession, settled: int, fanout: int = 2):
        self.spark, self.settled, self.fanout = spark, settled, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths_of: dict[str, str] = {}

    def _sums(self, names: list[str]) -> DataFrame:
        """(key, n_docs) over some runs."""
        if not names:
            return self.spark.createDataFrame([], self.SCHEMA)
        # a union of bucketed tables passes for partitioned by key, but its scans no longer go by buckets: keys would stay apart
        both = (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs")
        join = lambda a, b: a.hint("merge").join(b.withColumnRenamed("n_docs", "more"), "key", "full_outer").select("key", both)
        return functools.reduce(join, map(self.spark.table, names))

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = self.paths_of[name] = new_path(self.spark, f"run{level}")
        df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for x in names:
            self.spark.sql(f"DROP TABLE {x}")
            remove(self.spark, self.paths_of.pop(x))

    @property
    def paths(self) -> list[str]:
        return [self.paths_of[x] for x in self.names]

    @property
    def names(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def add(self, keys: DataFrame) -> None:
        """keys: one row (key) for each document and distinct key in it."""
        new = keys.groupBy("key").agg(F.count("*").alias("n_docs"))
        known = F.lit(0)
        for i, name in enumerate(self.names):
            run = self.spark.table(name).select("key", F.col("n_docs").alias(f"run{i}"))
            new, known = new.hint("merge").join(run, "key", "left"), known + F.coalesce(f"run{i}", F.lit(0))
        self._write(new.where(known < self.settled).select("key", "n_docs"), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._write(self._sums(old), level + 1)
        self._drop(old)

    def found_in(self, least: int) -> DataFrame:
        """(key) of keys in at least `least` documents; least may not exceed `settled`."""
        if least > self.settled:
            raise ValueError("counts are exact up to `settled` only")
        return self._sums(self.names).where(F.col("n_docs") >= least).select("key")

    def close(self) -> None:
        """Drop all runs."""
        self._drop(self.names)
        self.levels = []


def line_keys(text, min_chars: int):
    """array<binary>: the distinct keys of a text's lines."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([[*({_key(x, min_chars) for x in (t or "").encode().split(b"\n")} - {None})] for t in b.to_pylist()], pa.list_(pa.binary()))

    return F.arrow_udf(run, "array<binary>")(text)


def _kept(min_chars: int):
    @F.pandas_udf("kept string, n_lines bigint, n_dropped bigint")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, drop in batches:
            out = []
            for t, d in zip(text, drop, strict=True):
                lines = (t or "").split("\n")
                gone = set() if d is None else {bytes(x) for x in d}
                kept = [x for x in lines if _key(x.encode(), min_chars) not in gone] if gone else lines
                out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            yield pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])

    return run


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """df with text_col replaced by its kept lines, and n_lines, n_dropped (replacing columns so named).

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least min_chars
    code points found in at least min_docs documents lose all their lines in every document; other lines
    stay, joined by \\n. Each row is one document, even where rows or ids repeat or the id is null. A null or
    empty text is one empty line and gives an empty text. Texts of any length are read whole; no row is lost; an empty table stays empty.
    """
    spark = df.sparkSession
    # what a row drops is found by its id and a hash of its text: rows without an id, or of one id, share only with rows of the same text
    mark = F.xxhash64(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), mark.alias("mark"), F.explode(line_keys(F.col(text_col), min_chars)).alias("key"), F.pmod(F.xxhash64(F.col(id_col), mark), F.lit(batches)).alias("batch"))
    path = new_path(spark, "lines")
    rows.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(rows.schema).parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select("key"))
    common = written(runs.found_in(min_docs), "common")
    runs.close()
    drop = lines.join(common, "key").groupBy("id", "mark").agg(F.collect_set("key").alias("drop"))
    left, right = df.select(F.col(id_col).alias("id"), mark.alias("mark"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), drop
    both = left.join(right, left["id"].eqNullSafe(right["id"]) & (left["mark"] == right["mark"]), "left").select("row", "drop")
    both = both.withColumn("out", _kept(min_chars)(F.col("row").getField(text_col), F.col("drop")))
    own = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    return both.select(*[(F.col("out.kept") if c == text_col else F.col("row").getField(c)).alias(c) for c in own], F.col("out.n_lines").alias("n_lines"), F.col("out.n_dropped").alias("n_dropped"))
