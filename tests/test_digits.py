"""Slopes by their digits: ties, and terms that nearly cancel."""

import math

import pytest
from pyspark.sql import functions as F

from rdlab import queries
from rdlab.operators import bdrate

duckdb = pytest.importorskip("duckdb")


def test_digits_are_those_of_the_exact_value(spark):
    values = [(k * 10 + 5) / 1e7 * sign for k in range(100_000, 102_000) for sign in (1, -1)] + [0.0, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", queries._digits(F.col("v")).alias("d")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    want = dict(con.execute("SELECT v, printf('%.5e', v) FROM t").fetchall())
    assert len(got) == len(values)
    assert [r for r in got if r["d"] != want[r["v"]]] == []


def test_logs_are_those_of_the_c_library(spark):
    rates = [[k / 49152 for k in range(n, n + 11)] for n in range(5000, 30_000, 50)] + [[], None, [0.0, None, 1.0]]
    rows = spark.createDataFrame(list(enumerate(rates)), "id int, rates array<double>").coalesce(1)
    got = {r["id"]: r["y"] for r in rows.select("id", bdrate._logs(F.col("rates")).alias("y")).collect()}
    for i, x in enumerate(rates):
        assert got[i] == (None if x is None else [math.log10(v) if v else None for v in x])
