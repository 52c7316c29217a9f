"""A log of changes in files of whole transactions, as a batch and as a streaming source with log positions as offsets.

A file is ``<first end_lsn>-<last end_lsn>-<transactions>.parquet``, the numbers padded; its rows have the columns
of ``CHANGE_DDL``.  Positions come from the names, so planning a batch lists a folder and opens nothing.  Files that the stream has
acknowledged move to ``acknowledged/``, which is listed only by who goes back behind that position; what is there may be removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidefold.functions.shared import qualified
from tidefold.operators.changes import CHANGE_DDL

FORMAT, DONE = "tidefold_changes", "acknowledged"


@dataclass(frozen=True, order=True)
class LogFile:
    first: int
    last: int
    txns: int
    path: str


def _listed(where: fs.FileSystem, at: str) -> Iterator[LogFile]:
    for info in where.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        name = info.base_name
        if info.type == fs.FileType.File and name.endswith(".parquet") and not name.startswith((".", "_")):
            first, last, txns = name.removesuffix(".parquet").split("-")
            yield LogFile(int(first), int(last), int(txns), info.path)


def list_log(path: str, after: int = 0) -> list[LogFile]:
    """The files of a log that go on behind ``after``, by position."""
    where, at = fs.FileSystem.from_uri(path)
    found = {(f.first, f.last): f for f in _listed(where, at)}
    if after < (acknowledged(path) or 0):
        found |= {(f.first, f.last): f for f in _listed(where, f"{at}/{DONE}")}
    return sorted(f for f in found.values() if f.last > after)


def latest_lsn(path: str) -> int:
    """The position at the log's end, 0 if it is empty."""
    where, at = fs.FileSystem.from_uri(path)
    return max((f.last for f in _listed(where, at)), default=acknowledged(path) or 0)


def append(changes: DataFrame, path: str, txns_per_file: int = 500) -> None:
    """Write change rows as files of whole transactions in order of their positions.

    Transactions are dealt by range of position, sorted, and cut into files by the tasks; a file is written under
    another name first, so that no reader sees a part of it.  A task that runs again writes the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = fs.FileSystem.from_uri(path)
        where.create_dir(at)
        held: list[pa.RecordBatch] = []
        seen: list[int] = []

        def flush() -> None:
            if seen:
                name = f"{at}/{seen[0]:020d}-{seen[-1]:020d}-{len(seen)}"
                pq.write_table(pa.Table.from_batches(held), f"{name}.part", filesystem=where)
                where.move(f"{name}.part", f"{name}.parquet")
            held.clear()
            seen.clear()

        for batch in batches:
            lsn, start = batch.column(0).to_pylist(), 0
            for i, x in enumerate(lsn):
                if not seen or x != seen[-1]:
                    if len(seen) == txns_per_file:
                        held.append(batch.slice(start, i - start))
                        flush()
                        start = i
                    seen.append(x)
            held.append(batch.slice(start))
        flush()
        yield from ()

    names = [x.split(" ")[0] for x in CHANGE_DDL.replace("map<string, string>", "m").replace("array<string>", "a").split(", ")]
    path = qualified(changes.sparkSession, path)
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    changes.select(*names).repartitionByRange(parts, "end_lsn").sortWithinPartitions("end_lsn", "seq").mapInArrow(run, "x long").write.format("noop").mode("append").save()


def read_log(spark: SparkSession, path: str, after: int = 0, upto: int | None = None) -> DataFrame:
    """The changes behind ``after`` and up to ``upto``, as Spark's own scan of the files that hold any."""
    path = qualified(spark, path)
    files = [f for f in list_log(path, after) if upto is None or f.first <= upto]
    scheme = path.split("://")[0] + "://"
    out = spark.read.schema(CHANGE_DDL).parquet(*[scheme + f.path for f in files]) if files else spark.createDataFrame([], CHANGE_DDL)
    out = out.where(F.col("end_lsn") > after)
    return out if upto is None else out.where(F.col("end_lsn") <= upto)


@dataclass
class _Part(InputPartition):
    path: str
    after: int
    upto: int


def _rows(root: str, part: _Part, tables: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of the tables (all if none are named), and to each batch of rows one of op C with its last position."""
    where, _ = fs.FileSystem.from_uri(root)
    for batch in pq.ParquetFile(where.open_input_file(part.path)).iter_batches():
        at = {n: batch.schema.get_field_index(n) for n in ("end_lsn", "op", "table")}
        lsn = batch.column(at["end_lsn"])
        got = batch.filter(pc.and_(pc.greater(lsn, part.after), pc.less_equal(lsn, part.upto)))
        if not got.num_rows:
            continue
        last = pc.max(got.column(at["end_lsn"])).as_py()
        if tables:
            mine = pc.is_in(got.column(at["table"]), pa.array(tables))
            mark = [pa.array([{"end_lsn": last, "seq": 0, "op": "C"}.get(f.name)], f.type) for f in got.schema]
            yield pa.record_batch(mark, schema=pa.schema([pa.field(f.name, f.type) for f in got.schema]))
            got = got.filter(pc.and_(mine, pc.is_valid(got.column(at["table"]))))
        if got.num_rows:
            yield pa.record_batch(got.columns, schema=pa.schema([pa.field(f.name, f.type) for f in got.schema]))


class _Batch(DataSourceReader):
    def __init__(self, path: str, tables: list[str]) -> None:
        self.path, self.tables = path, tables

    def partitions(self) -> list[InputPartition]:
        return [_Part(f.path, 0, f.last) for f in list_log(self.path)] or [_Part("", 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _rows(self.path, partition, self.tables)


class _Stream(DataSourceStreamReader):
    """Offers at most ``max_txns`` further transactions at a time, in whole files; acknowledges what is committed.

    The folder is listed once for each batch.
    """

    def __init__(self, path: str, start: int, max_txns: int, tables: list[str]) -> None:
        self.path, self.start, self.max_txns, self.planned, self.tables = path, start, max_txns, start, tables
        self.files: list[LogFile] = []

    def initialOffset(self) -> dict:
        return {"lsn": self.start}

    def latestOffset(self) -> dict:
        txns = 0
        self.files = list_log(self.path, self.planned)
        for f in self.files:
            if txns and txns + f.txns > self.max_txns:
                break
            txns += f.txns
            self.planned = f.last
        return {"lsn": self.planned}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        planned = end["lsn"] == self.planned and self.files and self.files[0].first > start["lsn"]
        self.planned = max(self.planned, end["lsn"])
        files = self.files if planned else list_log(self.path, start["lsn"])
        return [_Part(f.path, start["lsn"], end["lsn"]) for f in files if f.last > start["lsn"] and f.first <= end["lsn"]]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield from _rows(self.path, partition, self.tables)

    def commit(self, end: dict) -> None:
        where, at = fs.FileSystem.from_uri(self.path)
        # never back, even by a stream that goes through the log again: it says which files have moved
        if end["lsn"] > (acknowledged(self.path) or 0):
            with where.open_output_stream(f"{at}/_acknowledged") as out:
                out.write(str(end["lsn"]).encode())
        where.create_dir(f"{at}/{DONE}")
        for f in _listed(where, at):
            if f.last <= end["lsn"]:
                where.move(f.path, f"{at}/{DONE}/{f.path.rsplit('/', 1)[1]}")

    def stop(self) -> None:
        pass


def keep_only(spark: SparkSession, folder: str, name: str) -> None:
    """Remove everything in a folder but what has the name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for x in files.listStatus(at) if files.exists(at) else []:
        if x.getPath().getName() != name:
            files.delete(x.getPath(), True)


def acknowledged(path: str) -> int | None:
    """The position up to which the stream has acknowledged the log; what is before it may be removed."""
    where, at = fs.FileSystem.from_uri(path)
    if where.get_file_info(f"{at}/_acknowledged").type != fs.FileType.File:
        return None
    with where.open_input_stream(f"{at}/_acknowledged") as f:
        return int(f.read())


class ChangeLog(DataSource):
    """Options: path, with its scheme on a cluster; tables, comma-joined (all); for streams start_lsn (0) and max_txns (500)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CHANGE_DDL

    def _tables(self) -> list[str]:
        return [t for t in self.options.get("tables", "").split(",") if t]

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], self._tables())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("start_lsn", "0")), int(self.options.get("max_txns", "500")), self._tables())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeLog)
