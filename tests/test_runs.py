"""Stores by buckets, state of the stream, searches with real trials, isolated trials, log files."""

import json
import os
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from rdlab.operators import isolated, trials
from rdlab.schema import ENCODES
from rdlab.sources import buckets, database, logs, scratch
from rdlab.streaming import totals as streaming


def _table(spark, tmp_path, rows, many=6):
    name = f"t{abs(hash(str(tmp_path)))}"
    buckets.create(spark, name, str(tmp_path / "store"), rows.schema, many)
    buckets.insert(name, rows.withColumn("arrival", F.lit(1)))
    return name


def _plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("Initial Plan")[0]


@pytest.mark.parametrize("partitions", ["4", "40"])
def test_the_stored_side_is_not_shuffled(spark, tmp_path, partitions):
    rows = spark.range(300).select(F.concat(F.lit("e"), "id").alias("id"), F.col("id").alias("v"))
    table = _table(spark, tmp_path, rows.where("v < 100"))
    buckets.insert(table, rows.where("v < 200").withColumn("arrival", F.lit(1)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for df, left in ((buckets.missing(rows, table), 100), (buckets.first_new(rows.union(rows).withColumn("arrival", F.rand()), table, "arrival"), 100)):
            plan = _plan(df)
            assert df.count() == left
            assert plan.count("Exchange hashpartitioning") == 1  # only what is new
            scan = plan[: plan.index("FileScan parquet")].splitlines()[-4:]
            assert not any("Exchange" in line for line in scan)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spark.table(table).count() == 200


def test_buckets_refuse_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "id string, v int")
    table = _table(spark, tmp_path, rows)
    with pytest.raises(FileExistsError):
        buckets.create(spark, "other", str(tmp_path / "store"), rows.schema, 6)
    buckets.insert(table, rows.limit(0).withColumn("arrival", F.lit(1)))
    again = spark.createDataFrame([("a", 2, 1), (None, 3, 1), ("b", 5, 2), ("b", 4, 1)], "id string, v int, arrival int")
    buckets.insert(table, again)
    assert {(r["id"], r["v"]) for r in spark.table(table).collect()} == {("a", 1), (None, 3), ("b", 4)}


def test_the_stream_resumes_and_does_not_read_the_store(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "id string, event_id long"
    part = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("e"), (F.col("id") % 50).cast("string")).alias("id"), F.col("id").alias("event_id")).coalesce(1)
    part(100, 130).write.mode("append").parquet(source)
    streaming.stream_upsert(spark.readStream.schema(schema).parquet(source), out, state, "event_id")
    first = {(r["id"], r["event_id"]) for r in spark.read.parquet(out).collect()}
    assert first == {(f"e{i % 50}", i) for i in range(100, 130)}
    # between runs the stored rows become unreadable; the next run must not need them
    hidden = str(tmp_path / "hidden")
    os.mkdir(hidden)
    names = [n for n in os.listdir(out) if n.endswith(".parquet")]
    for n in names:
        os.rename(f"{out}/{n}", f"{hidden}/{n}")
    part(0, 100).write.mode("append").parquet(source)
    streaming.stream_upsert(spark.readStream.schema(schema).parquet(source), out, state, "event_id")
    for n in names:
        os.rename(f"{hidden}/{n}", f"{out}/{n}")
    got = {(r["id"], r["event_id"]) for r in spark.read.parquet(out).collect()}
    assert got == first | {(f"e{i}", i) for i in range(30, 50)}  # ids 0 to 29 came before, at 100 to 129
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != streaming.ROCKS


def _payloads(spark, many=12):
    rows = [(f"d{i}", bytearray(bytes((i * j * j + 3 * j) % 256 for j in range(i * 7)))) for i in range(many)]
    return spark.createDataFrame([*rows, ("gone", None)], "id string, payload binary")


def test_search_with_trials_equals_the_sweep(spark):
    docs = _payloads(spark)
    wanted = docs.select("id", F.explode(F.array(*[F.lit(float(x)) for x in (0, 12, 30, 38, 51, 90)])).alias("target"))
    ran = []

    def join(tries):
        ran.append(tries.count())
        return tries.join(docs, "id").withColumn("codec", F.lit("coarse"))

    got = {(r["id"], r["target"]): (r["param"], r["status"]) for r in trials.search_measured(wanted, 0, 7, trials.encode_decode_measure, join, scratch.written).collect()}
    grid = docs.select("id", "payload", F.lit("coarse").alias("codec"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("param"))
    swept = {}
    for r in trials.run_trials(grid, trials.encode_decode_measure, trials.MEASURED_SCHEMA).collect():
        swept.setdefault(r["id"], []).append((r["param"], r["psnr"]))
    for (name, target), (param, status) in got.items():
        if name == "gone":
            assert (param, status) == (None, "error")
        else:
            best = min(swept[name], key=lambda x: (abs(x[1] - target), x[1] < target, -x[0] if x[1] >= target else x[0]))
            assert (param, status) == (best[0], "hit")
    assert len(ran) <= 4
    assert ran[0] == 13  # all targets of a document share a trial


def test_hanging_and_failing_trials_are_rows(spark):
    def run(codec, payload, param):
        if codec == "hangs":
            time.sleep(600)
        if codec == "raises":
            raise ValueError("no such codec")
        if codec == "dies":
            os._exit(3)
        return payload[: len(payload) // 2]

    isolated.register(spark, "run_odd", run, limit=1.0)
    docs = spark.createDataFrame([("a", bytearray(b"x" * 100)), ("b", None)], "source string, payload binary")
    codecs = ("hangs", "raises", "dies", "fine", "also")
    plan = spark.createDataFrame([(f"{s} {c}", s, c, 1, float(i)) for s in "ab" for i, c in enumerate(codecs)], "trial string, source string, codec string, param int, cost double")
    got = {r["id"]: r for r in isolated.run_dealt(plan, docs, 2, "run_odd").collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a hangs": "timeout", "a raises": "error", "a dies": "crash", "a fine": "ok", "a also": "ok"} | {f"b {c}": "error" for c in codecs}
    assert got["a fine"]["file_size_bytes"] == 50
    assert "no such codec" in got["a raises"]["error"]
    assert 1 <= got["a hangs"]["seconds"] < 20


def test_trials_are_dealt_by_cost(spark):
    plan = spark.range(64).select(F.format_string("t%02d", "id").alias("trial"), F.pow(F.lit(1.1), F.col("id")).alias("cost"))
    bins = {r["bin"]: (r["n"], r["cost"]) for r in isolated.dealt(plan, 4).groupBy("bin").agg(F.count("*").alias("n"), F.sum("cost").alias("cost")).collect()}
    assert {n for n, _ in bins.values()} == {16}
    costs = [c for _, c in bins.values()]
    assert max(costs) < 1.25 * min(costs)
    assert isolated.dealt(plan.limit(0), 4).isEmpty()


def test_vmaf_files_with_faults(spark, tmp_path):
    frames = [{"frameNum": i, "metrics": {"vmaf": 90.0 + i, "vif_scale0": 0.5, "ssim": 0.9, "ms_ssim": 0.8, "adm2": 0.7, "more": 1}} for i in range(3)]
    text = json.dumps({"version": "2", "frames": frames}, indent=4)
    for name, content in (("good", text), ("cut", text[:200]), ("bare", "{}"), ("none", '{"frames": []}'), ("text", "no json"), ("blank", " \n"), ("nothing", ""), ("a b+ü", text)):
        (tmp_path / f"{name}.json").write_text(content)
    (tmp_path / "other.log").write_text("x")
    got = {r["trial"]: r for r in logs.read_vmaf_files(spark, str(tmp_path)).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"good": None, "a b+ü": None, "cut": "not whole JSON", "bare": "no frames", "none": "no frames", "text": "not whole JSON", "blank": "empty"}
    assert (got["good"]["frames"], got["good"]["vmaf"], got["cut"]["vmaf"]) == (3, 90.0, None)
    assert logs.read_vmaf_files(spark, str(tmp_path), frame="mean").where("trial = 'good'").first()["vmaf"] == 91.0


def test_psnr_files_with_faults(spark, tmp_path):
    (tmp_path / "good.log").write_text("n:1 psnr_avg:30.0 mse_avg:2\nn:2 psnr_avg:inf  mse_avg:4\n\n")
    (tmp_path / "part.log").write_text("n:1 psnr_avg:x\nnothing here\nn:2 psnr_avg:20\n")
    (tmp_path / "bad.log").write_text("nothing\n")
    got = {(r["trial"], r["key"]): (r["mean"], r["frames"], r["bad_lines"]) for r in logs.read_psnr_files(spark, str(tmp_path)).collect()}
    assert got[("good", "psnr_avg")] == (float("inf"), 2, 0)
    assert got[("good", "mse_avg")] == (3.0, 2, 0)
    assert got[("part", "psnr_avg")] == (20.0, 2, 1)
    assert got[("bad", None)] == (None, 0, 1)
    assert len(got) == 6


def _trial(i):
    return tuple(f"{f.name}{i}" if f.dataType.simpleString() == "string" else i if f.dataType.simpleString() == "int" else i / 2 for f in ENCODES)


def test_databases_come_back(spark, tmp_path):
    rows = [_trial(i) for i in range(250)]
    database.write_database(spark.createDataFrame(rows, ENCODES).repartition(3), str(tmp_path / "db"), rows=40)
    assert len(list((tmp_path / "db").glob("*.db"))) >= 7
    assert not list((tmp_path / "db").glob("_*"))
    for size in (7, 1000):
        got = database.read_database(spark, str(tmp_path / "db"), rows=size)
        assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert got.schema == ENCODES


def test_a_database_of_another_program_is_read(spark, tmp_path):
    path = tmp_path / "results.db"
    db = sqlite3.connect(path)
    names = [database._stored(f.name) for f in ENCODES]
    db.execute(f"CREATE TABLE ENCODES (ENCODED_FILE TEXT, {', '.join(reversed(names))}, TEMP_FOLDER TEXT)")  # other order, no kinds
    for i in range(5):
        row = dict(zip(names, _trial(i), strict=True)) | {"WIDTH": float(i), "VMAF": str(i / 2)}
        db.execute(f"INSERT INTO ENCODES ({', '.join(row)}) VALUES ({', '.join('?' * len(row))})", list(row.values()))
    db.execute("DELETE FROM ENCODES WHERE ID = 'id2'")
    db.commit()
    assert sorted(map(tuple, database.read_database(spark, str(path), rows=2).collect())) == sorted(_trial(i) for i in (0, 1, 3, 4))
    db.execute("DELETE FROM ENCODES")
    db.commit()
    db.close()
    assert database.read_database(spark, str(path)).isEmpty()
    with pytest.raises(Exception, match="nothing-here"):
        database.read_database(spark, str(tmp_path / "nothing-here")).collect()
