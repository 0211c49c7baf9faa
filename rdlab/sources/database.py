"""Stores of trials kept in SQLite files: read by ranges of rows, and written as one or more files."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from rdlab.schema import ENCODES
from rdlab.sources.raw import FileWriter, Written, _open

TABLE = "ENCODES"
#: Fixed value: how the stored table spells this column.
SPELLED = {"source_file_size": "SOUCR_FILE_SIZE"}
#: Columns of the stored table that trials here don't have; they must not be null.
UNUSED = ("TEMP_FOLDER", "ENCODED_FILE")
_KINDS = {T.StringType: "TEXT", T.IntegerType: "INT", T.DoubleType: "REAL"}


def _stored(name: str) -> str:
    return SPELLED.get(name, name.upper())


@dataclass
class Rows(InputPartition):
    """Rows of a file whose rowid lies in [first, last); all rows without bounds."""

    path: str
    first: int | None
    last: int | None

    def __init__(self, path: str, first: int | None = None, last: int | None = None):
        super().__init__(None)
        self.path, self.first, self.last = path, first, last


def _connect(where: fs.FileSystem, path: str) -> sqlite3.Connection:
    """A read-only connection: to the file itself where it is local, else to its bytes in memory."""
    if isinstance(where, fs.LocalFileSystem):
        return sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)
    out = sqlite3.connect(":memory:")
    with where.open_input_file(path) as f:
        out.deserialize(f.read())
    return out


class StoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.rows, self.schema = options["path"], int(options.get("rows", 100_000)), schema

    def partitions(self) -> list[Rows]:
        where, root = _open(self.path)
        top = where.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = where.get_file_info(fs.FileSelector(root)) if top.type == fs.FileType.Directory else [top]
        out: list[Rows] = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if not isinstance(where, fs.LocalFileSystem):  # a range would read the whole file anyway
                out.append(Rows(f.path))
                continue
            db = _connect(where, f.path)
            lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {TABLE}").fetchone()
            db.close()
            if lo is not None:
                out += [Rows(f.path, k, k + self.rows) for k in range(lo, hi + 1, self.rows)]
        return out or [Rows("")]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, _ = _open(self.path)
        db, kind = _connect(where, partition.path), to_arrow_schema(self.schema)
        # rows come by the key, whatever kinds SQLite has kept
        names = ", ".join(f"CAST({_stored(f.name)} AS {_KINDS[type(f.dataType)]})" for f in self.schema)
        some = "" if partition.first is None else f" WHERE rowid >= {partition.first} AND rowid < {partition.last}"
        got = db.execute(f"SELECT {names} FROM {TABLE}{some}")
        while rows := got.fetchmany(10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
        db.close()


class StoreWriter(FileWriter, DataSourceArrowWriter):
    """SQLite files of at most `rows` rows each, made in memory and moved into place when the whole job has gone well."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        super().__init__(options)
        self.rows, self.schema = int(options.get("rows", 100_000)), schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, root = _open(self.path)
        hidden = f"{root}/_new-{self.job}"
        where.create_dir(hidden)
        names = [f.name for f in self.schema]
        columns = ", ".join(f"{_stored(f.name)} {_KINDS[type(f.dataType)]}{' PRIMARY KEY' if f.name == 'id' else ''}" for f in self.schema)
        unused = "".join(f", {c} TEXT NOT NULL DEFAULT ''" for c in UNUSED)
        insert = f"INSERT INTO {TABLE} ({', '.join(map(_stored, names))}) VALUES ({', '.join('?' * len(names))})"
        out: list[tuple[str, str]] = []
        db, n = None, 0

        def close() -> None:
            part = f"{hidden}/{uuid.uuid4().hex}"
            db.commit()
            with where.open_output_stream(part) as f:
                f.write(db.serialize())
            db.close()
            out.append((part, f"{root}/part-{uuid.uuid4().hex}.db"))

        for b in batches:
            for lo in range(0, b.num_rows, self.rows):
                part = b.slice(lo, self.rows)
                if db is not None and n + part.num_rows > self.rows:
                    close()
                    db = None
                if db is None:
                    db, n = sqlite3.connect(":memory:"), 0
                    db.execute(f"CREATE TABLE {TABLE} ({columns}{unused})")
                db.executemany(insert, zip(*(part.column(c).to_pylist() for c in names), strict=True))
                n += part.num_rows
        if db is not None:
            close()
        return Written(out)


class TrialStore(DataSource):
    """Format trialstore: SQLite files with the table of trials, read and written."""

    @classmethod
    def name(cls) -> str:
        return "trialstore"

    def schema(self) -> T.StructType:
        return ENCODES

    def reader(self, schema: T.StructType) -> StoreReader:
        return StoreReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> StoreWriter:  # noqa: ARG002
        if [f.name for f in schema] != [f.name for f in ENCODES]:
            raise ValueError("columns are those of the trial table")
        return StoreWriter(self.options, schema)


def read_database(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """The trials of an SQLite file, or of all files of a folder, in ranges of `rows` rows to a task.

    A local file (or one on a mount that all executors have) is read in place; one on another store is read whole into memory by one task. Columns that
    trials here don't have are left out. A file without the table, or no file at all, is an error; an empty table has no rows.
    """
    spark.dataSource.register(TrialStore)
    return spark.read.format("trialstore").option("rows", rows).load(path)


def write_database(encodes: DataFrame, path: str, rows: int = 100_000) -> None:
    """Append the trials to a folder as SQLite files of at most `rows` rows, which a task makes in memory. Ids are unique within a file; one that repeats there is an error."""
    encodes.sparkSession.dataSource.register(TrialStore)
    encodes.select(*[encodes[f.name].cast(f.dataType) for f in ENCODES]).write.format("trialstore").option("rows", rows).mode("append").save(path)
