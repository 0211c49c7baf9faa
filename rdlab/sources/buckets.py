"""A store of trials bucketed by id: what joins it by id is shuffled into its buckets, the store itself stays where it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rdlab.sources.store import exists


def create(spark: SparkSession, table: str, path: str, schema: T.StructType, buckets: int) -> None:
    """A new table in the catalog with its files in path. It needs an id column; buckets should grow with the store, as a bucket is a task of each join."""
    if exists(spark, path):
        raise FileExistsError(path)
    empty = spark.createDataFrame([], schema)
    empty.write.format("parquet").option("path", path).bucketBy(buckets, "id").sortBy("id").saveAsTable(table)


def even(spark: SparkSession) -> int:
    """Buckets whose tasks keep all cores of a session busy: 4 for each core, 16 at least. 16 buckets on 12 cores would take as long as 24."""
    return max(16, 4 * spark.sparkContext.defaultParallelism)


def of(spark: SparkSession, table: str) -> int:
    """The number of buckets of a table."""
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"{table} has no buckets")
    return int(rows[0]["data_type"])


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    """df dealt like the buckets, so that a join by id moves no row again."""
    return df.repartition(buckets, "id")


def missing(planned: DataFrame, table: str) -> DataFrame:
    """Rows of planned whose id isn't stored; only planned is shuffled. A null id is never stored, so it is missing."""
    spark = planned.sparkSession
    return _dealt(planned, of(spark, table)).join(spark.table(table).select("id").hint("merge"), "id", "left_anti")


def first_new(arrived: DataFrame, table: str, arrival: str) -> DataFrame:
    """The first arrival of each id that isn't stored; ties by any. One shuffle of what arrived serves both the choice and the join."""
    dealt = _dealt(arrived, of(arrived.sparkSession, table))
    first = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(arrival))).where("__n = 1").drop("__n")
    return first.join(arrived.sparkSession.table(table).select("id").hint("merge"), "id", "left_anti")


def insert(table: str, arrived: DataFrame, arrival: str = "arrival") -> None:
    """Append the first arrivals of ids that aren't stored. One writer at a time: two that run at once may both find an id missing."""
    spark = arrived.sparkSession
    schema, buckets = spark.table(table).schema, of(spark, table)
    rows = first_new(arrived, table, arrival).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
    rows.write.format("parquet").bucketBy(buckets, "id").sortBy("id").mode("append").saveAsTable(table)
