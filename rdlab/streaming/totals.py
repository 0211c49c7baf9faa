"""The running totals and the store, kept from a stream of completions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rdlab.operators.totals import totals


def stream_totals(stream: DataFrame, path: str, checkpoint: str, metrics: tuple[str, ...] = ("vmaf", "ssim")) -> None:
    """Read what is available and leave the totals of all so far in path. The state is one row per catalog key, so no watermark is needed.

    Each batch's complete result is a folder of its own, so that a repeated batch overwrites itself.
    """

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch:09d}")

    query = totals(stream, metrics).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    last = rows.agg({"batch": "max"}).first()[0]
    return rows.where(rows["batch"] == last).drop("batch")


class FirstOnly(StatefulProcessor):
    """Lets the first arrival of each id through: of a batch the row of the smallest arrival (ties by any), and none once an id is known."""

    def __init__(self, arrival: str):
        self.arrival = arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "yes boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802, ARG002
        if self.known.exists():
            return
        best = None
        for pdf in rows:
            both = pdf if best is None else pd.concat([best, pdf])
            best = both.sort_values(self.arrival, kind="stable").head(1)
        self.known.update((True,))
        yield best

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, arrival: str) -> None:
    """Insert each id once, the first arrival of the first batch that has it; resumable from its checkpoint.

    Which ids are stored is keyed state on the executors' disks, with changes saved to the checkpoint: a batch costs what it brings, and never reads the
    store. Files of a batch appear in path at once, and only once. The state keeps an entry for every id for good, as the store does. Null ids are one id.
    """
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        first = stream.groupBy("id").transformWithStateInPandas(FirstOnly(arrival), stream.schema, "append", "none")
        query = first.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
