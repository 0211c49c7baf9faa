"""Line runs counted over several batches."""

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from rdlab.llm import line_dedup


def test_counts_of_merged_runs_are_those_of_all_batches(spark):
    rows = [(i * i % 7919 % (500 + 900 * b), b) for b in range(5) for i in range(3000)]
    keys = spark.createDataFrame(pd.DataFrame(rows, columns=["n", "b"])).select("b", F.unhex(F.md5(F.col("n").cast("string"))).alias("key")).cache()
    runs = line_dedup.LineRuns(spark, settled=6, fanout=2)
    for b in range(5):
        runs.add(keys.where(F.col("b") == b).select("key"))
        for name in runs.names:
            assert spark.table(name).groupBy("key").count().where("count > 1").count() == 0
    assert len(runs.names) == 2  # both are summed
    n = Counter(bytes(r["key"]) for r in keys.collect())
    for least in (2, 6):
        got = [bytes(r["key"]) for r in runs.found_in(least).collect()]
        assert sorted(got) == sorted(k for k, v in n.items() if v >= least)
    runs.close()
    keys.unpersist()
