"""Trials as a table function: each in a child process with a time limit, dealt by predicted cost."""

from __future__ import annotations

import multiprocessing
import os
import pickle
import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from rdlab.operators.trials import PACKERS
from rdlab.plans.grid import numbered
from rdlab.sources import buckets
from rdlab.sources.scratch import written

SCHEMA = "id string, codec string, param int, source_bytes long, file_size_bytes long, seconds double, status string, error string"
#: What a codec takes for a byte, against zlib; only the order in which trials are dealt depends on them.
COST = {"zlib": 1.0, "bz2": 3.0, "lzma": 10.0}


class Child:
    """A process that runs trials one after the other. It is killed, and another one started, when a trial hangs or takes it down."""

    def __init__(self, run: Callable[[str, bytes, int], bytes]):
        self.run, self.process, self.pipe = run, None, None

    def _serve(self, pipe) -> None:  # noqa: ANN001
        while True:
            try:
                codec, payload, param = pipe.recv()
            except (EOFError, OSError):
                os._exit(0)
            try:
                pipe.send((len(self.run(codec, payload, param)), None))
            except BaseException as e:  # any failure of a trial is its result
                pipe.send((None, repr(e)[:200]))

    def _start(self) -> None:
        fork = multiprocessing.get_context("fork")
        self.pipe, theirs = fork.Pipe()
        self.process = fork.Process(target=self._serve, args=(theirs,), daemon=True)
        self.process.start()
        theirs.close()

    def stop(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None

    def trial(self, codec: str, payload: bytes, param: int, limit: float) -> tuple[int | None, str, str | None]:
        """Size, status and error; the limit is in seconds and holds for work in C too, as the child is killed."""
        if self.process is None:
            self._start()
        try:
            self.pipe.send((codec, payload, param))
            if not self.pipe.poll(limit):
                self.stop()
                return None, "timeout", f"more than {limit:g} s"
            size, error = self.pipe.recv()
        except (EOFError, OSError, pickle.PickleError, struct.error) as e:
            code = self.process.exitcode
            self.stop()
            return None, "crash", f"exit code {code}: {e!r}"[:200]
        return size, "error" if error else "ok", error


def _pack(codec: str, payload: bytes, param: int) -> bytes:
    return PACKERS[codec](payload, param)


def register(spark: SparkSession, name: str = "run_trial", run: Callable[[str, bytes, int], bytes] = _pack, limit: float = 60.0) -> None:
    """A table function for SQL: name(TABLE(rows) PARTITION BY bin ORDER BY cost DESC) of rows id, codec, param, payload gives SCHEMA, a row for each.

    A trial that raises is a row of status error, one beyond the limit timeout, one that takes its process down crash; the others go on.
    """
    import time

    from pyspark.sql.functions import udtf

    class RunTrial:
        def __init__(self) -> None:
            self.child = Child(run)

        def eval(self, row: Row) -> Iterator[tuple]:
            payload = row["payload"]
            if payload is None:
                yield row["id"], row["codec"], row["param"], None, None, 0.0, "error", "no payload"
                return
            began = time.monotonic()
            size, status, error = self.child.trial(row["codec"], bytes(payload), row["param"], limit)
            yield row["id"], row["codec"], row["param"], len(payload), size, time.monotonic() - began, status, error

        def terminate(self) -> Iterator[tuple]:
            self.child.stop()
            yield from ()

    spark.udtf.register(name, udtf(RunTrial, returnType=SCHEMA))


def bins_for(spark: SparkSession) -> int:
    """Bins for a session: 16 for each core. Bins are hashed to tasks, so with about as many bins as cores some tasks get several and some cores none."""
    return max(16, 16 * spark.sparkContext.defaultParallelism)


def dealt(plan: DataFrame, bins: int) -> DataFrame:
    """plan (trial, cost, ...) with its bin: trials in descending order of cost go to the bins in turn, there and back, so that bins cost about the same.

    The order comes from a range partitioning of the narrow plan, which must hold no payloads; trial is unique. Null costs count as 0.
    """
    cost = F.coalesce(F.col("cost"), F.lit(0.0))
    rows = numbered(plan.withColumn("cost", cost).withColumn("__less", -cost), ["__less", "trial"], "__place")
    turn = F.col("__place") % (2 * bins)
    return rows.withColumn("bin", F.when(turn < bins, turn).otherwise(2 * bins - 1 - turn).cast("int")).drop("__less", "__place")


def run_dealt(plan: DataFrame, payloads: DataFrame, bins: int, function: str = "run_trial") -> DataFrame:
    """Run (trial, source, codec, param, cost) on payloads (source, payload) by a registered table function, longest trials of a bin first."""
    spark = plan.sparkSession
    rows = dealt(plan, bins).join(payloads, "source").select(F.col("trial").alias("id"), "codec", "param", "payload", "cost", "bin")
    return spark.sql(f"SELECT t.* FROM {function}(TABLE(SELECT * FROM {{rows}}) PARTITION BY bin ORDER BY cost DESC) AS t", rows=rows)


def resume(plan: DataFrame, payloads: DataFrame, table: str, bins: int, run: int, function: str = "run_trial") -> None:
    """Run what a bucketed store of results lacks of a plan, and append it with the number of the run; failures are results too, so they aren't run again.

    The store needs the columns of SCHEMA and run (int). Results are written before they are appended, so that a lost task never repeats finished trials of others.
    """
    lacking = buckets.missing(plan.withColumn("id", F.col("trial")), table).select(*[F.col(f"`{c}`") for c in plan.columns])
    done = written(run_dealt(lacking, payloads, bins, function), "results")
    buckets.insert(table, done.withColumns({"run": F.lit(run), "arrival": F.lit(1)}))
