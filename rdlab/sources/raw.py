"""Raw sequences as files: frames read by byte ranges, and contents written a file a row.

Files are opened through pyarrow's file systems (local paths, and URIs such as hdfs:// or s3://), by the tasks themselves.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BATCH_BYTES = 8 << 20  #: frames of one Arrow batch


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + quote(posixpath.abspath(path)))


@dataclass
class Ranges(InputPartition):
    """Frames [first, last) of some files, by their names in the folder."""

    parts: list[tuple[str, int, int]]

    def __init__(self, parts: list[tuple[str, int, int]]):
        super().__init__(None)
        self.parts = parts


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        number = lambda name, default: int(options.get(name, default))
        self.path, self.size = options["path"], number("size", 0)
        if self.size < 1:
            raise ValueError("size: the bytes of a frame")
        self.range_bytes, self.partition_bytes = number("range_bytes", 64 << 20), number("partition_bytes", 64 << 20)
        self.first, self.count = number("first", 0), number("count", -1)

    def partitions(self) -> list[Ranges]:
        """Ranges of whole frames, range_bytes at most each, dealt in the order of the files to partitions of partition_bytes."""
        where, root = _open(self.path)
        found = where.get_file_info(fs.FileSelector(root, recursive=False)) if where.get_file_info(root).type == fs.FileType.Directory else [where.get_file_info(root)]
        step = max(1, self.range_bytes // self.size)
        out: list[Ranges] = []
        held, room = [], self.partition_bytes
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            last = f.size // self.size  # a shorter rest is no frame
            last = last if self.count < 0 else min(last, self.first + self.count)
            for lo in range(self.first, last, step):
                hi = min(last, lo + step)
                if held and room < (hi - lo) * self.size:
                    out.append(Ranges(held))
                    held, room = [], self.partition_bytes
                held.append((f.base_name, lo, hi))
                room -= (hi - lo) * self.size
        return [*out, Ranges(held)] if held else out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        where, root = _open(self.path)
        folder = root if where.get_file_info(root).type == fs.FileType.Directory else posixpath.dirname(root)
        many = max(1, BATCH_BYTES // self.size)
        for base, lo, hi in partition.parts:
            path, name = posixpath.join(folder, base), unquote(base)
            with where.open_input_file(path) as f:
                for at in range(lo, hi, many):
                    n = min(many, hi - at)
                    data = f.read_at(n * self.size, at * self.size)
                    if len(data) != n * self.size:
                        raise OSError(f"{path} is shorter than it was")
                    frames = pa.Array.from_buffers(pa.binary(self.size), n, [None, pa.py_buffer(data)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), frames], ["name", "frame_no", "frame"])


@dataclass
class Written(WriterCommitMessage):
    """Files to move into place, by (present, later) path; or a folder all of whose files keep their names, so that the message doesn't grow with them."""

    files: list[tuple[str, str]]
    folder: str | None = None


class FileWriter(DataSourceArrowWriter):
    """A file for each row; names appear when the whole job has gone well, and files of failed tries don't."""

    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, root = _open(self.path)
        folder = uuid.uuid4().hex  # of this try only
        hidden = f"{root}/_new-{self.job}/{folder}"
        where.create_dir(hidden)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                with where.open_output_stream(f"{hidden}/{quote(name, safe=' ')}") as f:
                    if content.is_valid:
                        f.write(content.as_buffer())
        return Written([], folder)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = _open(self.path)
        for m in messages:
            for part, name in m.files if m else []:
                where.move(part, name)
            if m and m.folder:
                for f in where.get_file_info(fs.FileSelector(f"{root}/_new-{self.job}/{m.folder}")):
                    where.move(f.path, f"{root}/{f.base_name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, root = _open(self.path)
        if where.get_file_info(f"{root}/_new-{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/_new-{self.job}")


class RawFrames(DataSource):
    """Format rawframes. Reading: (name, frame_no, frame), options size, first, count, range_bytes, partition_bytes. Writing: (name string, content binary), a file a row."""

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return "name string, frame_no long, frame binary"

    def reader(self, schema) -> FrameReader:  # noqa: ANN001
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> FileWriter:  # noqa: ANN001
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("rows are (name, content)")
        return FileWriter(self.options)


def read_frames(spark: SparkSession, path: str, size: int, first: int = 0, count: int | None = None, range_bytes: int = 64 << 20, partition_bytes: int = 64 << 20) -> DataFrame:
    """(name, frame_no, frame): frames of `size` bytes of the file path, or of the files of a folder, from frame `first` on, `count` of each file at most.

    A task reads its ranges by offset, so a file may be of any length and no more than a batch of frames is held. A rest shorter than a frame is left
    out; an empty file, or one of less than a frame, has no rows. Names that begin with _ or . are skipped. The listing comes to the driver, as with Spark's own files.
    """
    spark.dataSource.register(RawFrames)
    options = {"size": size, "first": first, "count": -1 if count is None else count, "range_bytes": range_bytes, "partition_bytes": partition_bytes}
    return spark.read.format("rawframes").options(**options).load(path)


def write_files(df: DataFrame, path: str, name_col: str = "name", content_col: str = "content") -> None:
    """A file for each row; a null content is an empty file. Names are escaped like in a URI; two rows of one name leave one of them."""
    df.sparkSession.dataSource.register(RawFrames)
    df.select(df[name_col].cast("string").alias("name"), df[content_col].cast("binary").alias("content")).write.format("rawframes").mode("append").save(path)
