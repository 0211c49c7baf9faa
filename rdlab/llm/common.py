"""Shared pieces of the training-data operators: the shared folder, written tables, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and line definitions.
SPACE = r"[\x20\x09-\x0D]"

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, on one machine only: on a cluster its executors could not share it."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-"))
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which any executor can read again after a loss."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ours that a later one has replaced."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs started within pass rows to Python in Arrow batches of about this many bytes, where rows are large and a batch of 64 MB, on both sides, is too much."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Tables:
    """Written tables of one operator, removed as soon as no later step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.paths.pop(id(t))[1])

    def only(self, *tables: DataFrame) -> None:
        """Keep these tables and remove all others."""
        kept = {id(t) for t in tables}
        self.drop(*[t for k, (t, _) in [*self.paths.items()] if k not in kept])


def passing(df: DataFrame, id_col: str, ids: DataFrame, bits: int = 26) -> DataFrame:
    """Rows of df whose id may be in the column id_col of ids, which keeps others out of a shuffle; null ids never pass.

    A bitmap of 2^bits places of hashed ids is broadcast: 8 MB by default, however many ids there are. With many more ids than places nearly all rows pass.
    """
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << bits))
    marks = ids.where(F.col(id_col).isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits"))
    rows = df.where(F.col(id_col).isNotNull()).withColumn("__bucket", F.bitmap_bucket_number(place))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.floor(byte / F.pow(F.lit(2.0), at % 8)).cast("long") % 2 == 1
    return rows.join(F.broadcast(marks), "__bucket").where(hit).select(*df.columns)


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and a sum of their hashes, to tell whether a round has changed them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b) of longs: (node, component), component the smallest node.

    Large-star and small-star steps in turn; each round is a written table, and only one number per
    round comes to the driver. Nodes without an edge to another node are not returned; null ends are ignored.
    A node with very many edges is a hot key only of joins between written tables, which the adaptive plan can split, and of aggregates, which sum before they meet.
    """
    tables = Tables(edges.sparkSession)
    e = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = tables.written(e, name)
    before = _mark(e)
    while before[0]:
        start = e
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        high = tables.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        e = both.join(high, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = tables.written(e, name)
        old = [start, high, e]
        low = tables.written(e.groupBy("a").agg(F.min("b").alias("m")), name)
        e = e.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = tables.written(e.select("x.a", "x.b").where("a <> b").distinct(), name)
        tables.drop(*old, low)
        after = _mark(e)
        if after == before:
            break
        before = after
    up = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return up.union(e.select("b", "b").distinct())
