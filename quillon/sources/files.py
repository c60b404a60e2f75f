"""Triple files as a data source of Spark: `spark.read.format("triples")` and `df.write.format("triples")`.

Files of tab-separated lines are read by ranges of bytes; a line belongs to the range in which it
begins, and `offset`, the place of its first byte, orders the lines of a file. Writers put their rows
into a staging folder; only when all tasks have ended are the files moved to their place, and if any task
fails they go; what a task that is killed meanwhile leaves there is no data to any reader. Paths are those that pyarrow resolves (a folder, a file, or a glob of them; file:, hdfs:, s3:).
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a file that a task reads.
RANGE = 64 << 20


def _resolved(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Files and their sizes, in order of path; names that begin with _ or . are no data."""
    fs, base = _resolved(path)
    fixed = re.split(r"[*?\[]", base)[0]
    root = base if fixed == base else fixed.rpartition("/")[0] or "/"
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else []
    out = [(x.path, x.size) for x in found if x.type == pafs.FileType.File and not any(part[0] in "_." for part in x.path[len(root) :].split("/") if part)]
    out = [x for x in out if fixed == base or fnmatch.fnmatch(x[0], base)]
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class TripleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.fields = int(options.get("fields", 3))
        self.strict = options.get("strict", "true").lower() == "true"
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[Range]:
        return [Range(path, a, min(a + self.range, size)) for path, size in _files(self.path) for a in range(0, max(size, 1), self.range)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _resolved(self.path)
        names = ["head", "relation", "tail", "file", "offset"]
        rows: list[tuple] = []
        with fs.open_input_file(partition.path) as raw:
            place, held = partition.start, b""
            if place:  # a line that began before belongs to the range before
                raw.seek(place - 1)
                if raw.read(1) != b"\n":
                    line, held = _line(raw, held)
                    place += len(line)
            while place < partition.end:
                line, held = _line(raw, held)
                if not line:
                    break
                parts = line.decode("utf-8", "replace").rstrip("\r\n").strip().split("\t")
                if len(parts) == self.fields if self.strict else len(parts) >= self.fields:
                    rows.append((*parts[:3], partition.path, place))
                place += len(line)
                if len(rows) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


def _line(f, held: bytes) -> tuple[bytes, bytes]:
    """The next line with its end, and what was read beyond it."""
    while (k := held.find(b"\n")) < 0:
        more = f.read(1 << 16)
        if not more:
            return held, b""
        held += more
    return held[: k + 1], held[k + 1 :]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class TripleWriter(DataSourceWriter):
    """Rows (head, relation, tail, and split if there) as train.txt, valid.txt and test.txt parts, or one set of parts without a split."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.names = schema.fieldNames()
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _base(self) -> tuple[pafs.FileSystem, str]:
        fs, base = _resolved(self.path)
        return fs, base.rstrip("/")

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        fs, base = self._base()
        task = TaskContext.get()
        part = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        open_: dict[str, object] = {}
        try:
            for row in iterator:
                split = row["split"] if "split" in self.names else ""
                name = f"{split}/{part}.txt" if split else f"{part}.txt"
                if name not in open_:
                    fs.create_dir(f"{base}/{self.staging}/{split}", recursive=True)
                    open_[name] = fs.open_output_stream(f"{base}/{self.staging}/{name}")
                open_[name].write(f"{row['head']}\t{row['relation']}\t{row['tail']}\n".encode())
        finally:
            for f in open_.values():
                f.close()
        return Written(sorted(open_))

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = self._base()
        fs.create_dir(base, recursive=True)
        names = [n for m in messages if m for n in m.files]
        old = self._present() if self.overwrite else []
        for n in names:
            fs.create_dir(f"{base}/{n}".rpartition("/")[0], recursive=True)
            fs.move(f"{base}/{self.staging}/{n}", f"{base}/{n}")
        for p in old:  # only now: a stop before leaves the old rows
            fs.delete_file(p)
        self.abort(messages)

    def _present(self) -> list[str]:
        try:
            return [p for p, _ in _files(self.path)]
        except FileNotFoundError:
            return []

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = self._base()
        if fs.get_file_info(f"{base}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.staging}")


class TripleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "triples"

    def schema(self) -> str:
        return "head string, relation string, tail string, file string, offset long"

    def reader(self, schema: StructType) -> TripleReader:
        return TripleReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TripleWriter:
        return TripleWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(TripleFiles)
