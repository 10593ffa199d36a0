"""A log of runs that takes a run's rows as a whole or not at all.

Tasks write their rows to files of their own; nobody reads these until the driver's commit names them
in the run's manifest, which is one file. A failed job leaves no manifest, and its files are taken
away. A run that is written again, by a replay or by a second driver, finds its manifest and adds
nothing. Runs have manifests of their own, so writers never touch each other's files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha1
from threading import Lock
from weakref import WeakSet

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _open(place: str) -> tuple[FileSystem, str]:
    fs, path = FileSystem.from_uri(place if ":/" in place else f"file://{place}")
    return fs, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class RunWriter(DataSourceWriter):
    def __init__(self, place: str, run: str):
        self.place, self.run = place, run
        self.key = sha1(run.encode()).hexdigest()

    def write(self, iterator) -> Written:
        fs, base = _open(self.place)
        fs.create_dir(f"{base}/rows", recursive=True)
        name, n = f"{self.key}-{uuid.uuid4().hex}.jsonl", 0
        try:
            with fs.open_output_stream(f"{base}/rows/{name}") as out:
                for row in iterator:
                    out.write((json.dumps(list(row)) + "\n").encode())
                    n += 1
        except BaseException:  # the driver never hears of this file
            self._drop(fs, f"{base}/rows/{name}")
            raise
        return Written(name, n)

    @staticmethod
    def _drop(fs: FileSystem, path: str) -> None:
        if fs.get_file_info(path).type == FileType.File:
            fs.delete_file(path)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _open(self.place)
        manifest = f"{base}/runs/{self.key}.json"
        if fs.get_file_info(manifest).type == FileType.File:
            self.abort(messages)
            return
        fs.create_dir(f"{base}/runs", recursive=True)
        draft = f"{base}/runs/.{self.key}-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({"run": self.run, "files": [m.file for m in messages if m and m.rows]}).encode())
        fs.move(draft, manifest)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _open(self.place)
        for m in messages:
            if m:
                self._drop(fs, f"{base}/rows/{m.file}")


@dataclass
class _File(InputPartition):
    run: str | None
    path: str


class RunReader(DataSourceReader):
    """One partition per committed file."""

    def __init__(self, place: str):
        self.place = place

    def partitions(self) -> list[_File]:
        fs, base = _open(self.place)
        out = []
        for i in fs.get_file_info(FileSelector(f"{base}/runs", allow_not_found=True)):
            if i.type == FileType.File and i.base_name.endswith(".json") and not i.base_name.startswith("."):
                with fs.open_input_stream(i.path) as f:
                    m = json.loads(f.read())
                out += [_File(m["run"], f"{base}/rows/{name}") for name in m["files"]]
        return out or [_File(None, "")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.run is None:
            return
        fs, _ = _open(self.place)
        with fs.open_input_file(partition.path) as f:
            for line in f.read().splitlines():
                yield (partition.run, *json.loads(line))


class RunLog(DataSource):
    """``df.write.format("run_log").option("run", id).mode("append").save(place)``; text columns only."""

    @classmethod
    def name(cls) -> str:
        return "run_log"

    def schema(self) -> str:
        return ", ".join(["run string", *[f"`{c}` string" for c in json.loads(self.options["columns"])]])

    def reader(self, schema: StructType) -> RunReader:
        return RunReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        if overwrite:
            raise ValueError("a run log only grows")
        return RunWriter(self.options["path"], self.options["run"])


_LOCK, _KNOWN = Lock(), WeakSet()


def _register(spark: SparkSession) -> None:
    """Once a session: to register a name anew takes it away for a moment from writers in other threads."""
    with _LOCK:
        if spark not in _KNOWN:
            spark.dataSource.register(RunLog)
            _KNOWN.add(spark)


def append_run(rows: DataFrame, place: str, run: str) -> None:
    """Add a run's rows, under the columns of ``sinks.fixed_columns``, once."""
    _register(rows.sparkSession)
    rows.write.format("run_log").option("run", run).option("columns", json.dumps(rows.columns)).mode("append").save(place)


def read_runs(spark: SparkSession, place: str, columns: Sequence[str]) -> DataFrame:
    """run and the columns, of committed runs alone; a place that no run has reached is empty."""
    _register(spark)
    return spark.read.format("run_log").option("columns", json.dumps(list(columns))).load(place)
