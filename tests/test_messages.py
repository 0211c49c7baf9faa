"""What tasks that write or read raw files send to the driver."""

import pickle

import pyarrow as pa
from pyspark.sql import functions as F

from rdlab.sources import raw


def _batch(n):
    return pa.RecordBatch.from_arrays([pa.array([f"doc {i}/a%" for i in range(n)]), pa.array([b"x" * 8] * n, pa.binary())], ["name", "content"])


def test_messages_of_writers_do_not_grow_with_files(tmp_path):
    sizes = []
    for n in (10, 1000):
        path = str(tmp_path / f"out {n}")
        w = raw.FileWriter({"path": path})
        lost = w.write(iter([_batch(3)]))  # a try that isn't committed
        done = w.write(iter([_batch(n)]))
        sizes.append(len(pickle.dumps(done)))
        w.commit([done, None])
        assert len(list((tmp_path / f"out {n}").iterdir())) == n and lost.folder != done.folder
        parts = raw.FrameReader({"path": path, "size": "8"}).partitions()
        assert path not in repr([p.parts for p in parts])  # names only
    assert sizes[1] - sizes[0] < 10


def test_files_come_back_from_a_folder_and_from_one_path(spark, tmp_path):
    rows = spark.createDataFrame([("a b/%25", bytearray(b"12345678")), ("c", None), ("d", bytearray(b"abcdefghi"))], "name string, content binary")
    path = str(tmp_path / "some folder")
    raw.write_files(rows, path)
    got = {(r["name"], r["frame_no"], bytes(r["frame"])) for r in raw.read_frames(spark, path, 4).collect()}
    assert got == {("a b/%25", 0, b"1234"), ("a b/%25", 1, b"5678"), ("d", 0, b"abcd"), ("d", 1, b"efgh")}
    assert {bytes(r["frame"]) for r in raw.read_frames(spark, path + "/d", 4).select(F.col("frame")).collect()} == {b"abcd", b"efgh"}
