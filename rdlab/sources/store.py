"""The store of trials: a Parquet table partitioned by subsampling, one row per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rdlab.schema import ENCODES


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def create_encodes(spark: SparkSession, path: str, resume: bool = False) -> None:
    """A new run fails if the store exists, a resumed one if it does not."""
    if resume != exists(spark, path):
        raise FileNotFoundError(path) if resume else FileExistsError(path)
    if not resume:
        spark.createDataFrame([], ENCODES).write.partitionBy("sub_sampling").parquet(path)


def read_encodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENCODES).parquet(path)


def new_trials(arrived: DataFrame, stored: DataFrame, arrival: str) -> DataFrame:
    """The first arrival of each id that isn't stored."""
    first = arrived.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(arrival))).where("__n = 1").drop("__n")
    return first.join(stored.select("id"), "id", "left_anti")


def insert_trials(spark: SparkSession, path: str, arrived: DataFrame, arrival: str = "arrival") -> None:
    """Append what is new; rows whose id is taken are left out and the run goes on. One writer at a time: two that run at once may both find an id missing."""
    rows = new_trials(arrived, read_encodes(spark, path), arrival)
    rows.select(*[F.col(f.name).cast(f.dataType) for f in ENCODES]).write.mode("append").partitionBy("sub_sampling").parquet(path)


def report_sink(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def rd_series_sink(series: DataFrame, path: str) -> None:
    """Plotted series, one folder per subsampling."""
    series.write.mode("overwrite").partitionBy("sub_sampling").parquet(path)


