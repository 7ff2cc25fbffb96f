"""Files as a table of facts, and tables as one file a row: a data source and a sink.

Both reach their files through pyarrow, so paths may be local ones that all nodes share, or of a store that pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes that a task reads, about, and that it holds at once.
PART, BLOCK = 128 << 20, 1 << 20


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


@dataclass
class Ranges(InputPartition):
    """Parts of files: path, size of the file, begin, end."""

    parts: list[tuple[str, int, int, int]]


class FileFacts(DataSource):
    """Rows path, byte_length, head, tail, counts: a row for each range of each file of a folder, at any depth.

    Options: path; head and tail, how many bytes of a file's ends are given, with its first and last range; tokens, a JSON list
    of strings whose places are counted; part, the bytes of a range. A token that begins in a range counts there, so the
    counts of a file's ranges add up; tokens that can overlap themselves are counted at every place.
    """

    @classmethod
    def name(cls) -> str:
        return "folio_file_facts"

    def schema(self) -> str:
        return "path string, byte_length long, head binary, tail binary, counts array<long>"

    def reader(self, schema) -> DataSourceReader:
        return _FactsReader(self.options)


class _FactsReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.part = options["path"], int(options.get("part", PART))
        self.head, self.tail = int(options.get("head", 0)), int(options.get("tail", 0))
        self.tokens = [t.encode("latin-1") for t in json.loads(options.get("tokens", "[]"))]

    def partitions(self) -> list[Ranges]:
        """Ranges of about ``part`` bytes: large files cut, small ones together."""
        store, root = _files(self.path)
        out, held = [], 0
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type != fs.FileType.File or any(p[:1] in ("_", ".") for p in info.path[len(root) :].strip("/").split("/")):
                continue
            for begin in range(0, max(info.size, 1), self.part):
                end = min(info.size, begin + self.part)
                if not out or held + end - begin > self.part or len(out[-1].parts) >= 10_000:
                    out.append(Ranges([]))
                    held = 0
                out[-1].parts.append((info.path, info.size, begin, end))
                held += end - begin
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = _files(self.path)
        for path, size, begin, end in partition.parts:
            with store.open_input_file(path) as file:
                head = file.read_at(min(self.head, size), 0) if begin == 0 and size else b""
                tail = file.read_at(min(self.tail, size), size - min(self.tail, size)) if end == size and size else b""
                yield path, size, head, tail, self._count(file, begin, end, size)

    def _count(self, file, begin: int, end: int, size: int) -> list[int]:
        counts, longest = [0] * len(self.tokens), max(map(len, self.tokens), default=1)
        for at in range(begin, end, BLOCK) if self.tokens else ():
            stop = min(end, at + BLOCK)
            block = file.read_at(min(size, stop + longest - 1) - at, at)
            for i, token in enumerate(self.tokens):
                found = block.find(token)
                while 0 <= found < stop - at:
                    counts[i] += 1
                    found = block.find(token, found + 1)
        return counts


def file_facts(spark: SparkSession, path: str, head: int = 0, tail: int = 0, tokens: tuple[str, ...] = (), part: int = PART) -> DataFrame:
    """path, byte_length, head, tail, counts (of each token) of every file below a folder, hidden ones and those in folders that begin with _ aside.

    Tasks read ranges, so a file of any size is spread over tasks and none holds more than a block of it.
    """
    spark.dataSource.register(FileFacts)
    rows = spark.read.format(FileFacts.name()).options(head=head, tail=tail, tokens=json.dumps(list(tokens)), part=part).load(path)
    sums = [F.sum(F.col("counts")[i]).alias(f"_{i}") for i in range(len(tokens))]
    ends = [F.max(c).alias(c) for c in ("head", "tail")]  # other ranges of a file have an empty one
    found = rows.groupBy("path", "byte_length").agg(*ends, *sums)
    return found.select("path", "byte_length", "head", "tail", F.array(*(F.col(f"_{i}") for i in range(len(tokens)))).cast("array<long>").alias("counts"))


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


class FilePerRow(DataSource):
    """A sink: each row (name string, body string or binary) is a file below path, in a folder for each task.

    Tasks write into a staging folder. Only when all have ended are their folders moved to the path, one move for a task; if one
    fails for good, staging is deleted and the path is as it was. Mode overwrite replaces what was there.
    """

    @classmethod
    def name(cls) -> str:
        return "folio_file_per_row"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"], schema.names, overwrite)


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool) -> None:
        if {"name", "body"} - set(names):
            raise ValueError(f"rows need a name and a body, not {names}")
        self.path, self.at, self.overwrite = path, (names.index("name"), names.index("body")), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Written:
        store, root = _files(self.path)
        folder, files, made = uuid.uuid4().hex, 0, set()
        for row in iterator:
            name, body = row[self.at[0]], row[self.at[1]]
            steps = (name or "").split("/")
            if any(s in ("", ".", "..") for s in steps) or steps[0].startswith("_"):
                raise ValueError(f"not a name for a file: {name!r}")
            target = f"{root}/{self.staging}/{folder}/{'/'.join(steps[:-1])}".rstrip("/")
            if target not in made:
                store.create_dir(target, recursive=True)
                made.add(target)
            if store.get_file_info(f"{target}/{steps[-1]}").type != fs.FileType.NotFound:
                raise ValueError(f"two rows are called {name!r}")
            with store.open_output_stream(f"{target}/{steps[-1]}") as out:
                out.write(body.encode() if isinstance(body, str) else bytes(body or b""))
            files += 1
        return _Written(folder, files)

    def commit(self, messages: list[_Written]) -> None:
        store, root = _files(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name != self.staging:
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        for i, message in enumerate(m for m in messages if m and m.files):
            store.move(f"{root}/{self.staging}/{message.folder}", f"{root}/part-{i:05}-{message.folder}")
        self.abort(messages)

    def abort(self, messages) -> None:
        store, root = _files(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


def write_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Each of rows(name, body) as a file below path; all of them or, if a task fails, none. A name may lead through folders."""
    rows.sparkSession.dataSource.register(FilePerRow)
    rows.select("name", "body").write.format(FilePerRow.name()).mode(mode).save(path)


@dataclass
class Folder(InputPartition):
    """A folder that a task of write_files() has written."""

    path: str


class TextFiles(DataSource):
    """Rows name, body: the files below path that FilePerRow wrote, as whole texts. The driver lists a folder for each task, tasks what is in theirs."""

    @classmethod
    def name(cls) -> str:
        return "folio_text_files"

    def schema(self) -> str:
        return "name string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _TextReader(self.options["path"])


class _TextReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Folder]:
        store, root = _files(self.path)
        found = [Folder(i.path) for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name.startswith("part-")]
        return found or [Folder("")]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, _ = _files(self.path)
        names, bodies, held = [], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.string())], ["name", "body"])
        ahead = [partition.path] if partition.path else []
        while ahead:
            for info in store.get_file_info(fs.FileSelector(ahead.pop())):
                if info.type == fs.FileType.Directory:
                    ahead.append(info.path)
                    continue
                with store.open_input_stream(info.path) as file:
                    raw = file.read()
                names.append(info.path[len(partition.path) + 1 :])
                bodies.append(raw.decode("utf-8", "replace"))
                held += len(raw)
                if held > 8 * BLOCK or len(names) >= 10_000:
                    yield batch()
                    names, bodies, held = [], [], 0
        yield batch()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, body of the files that write_files() wrote: whole texts."""
    spark.dataSource.register(TextFiles)
    return spark.read.format(TextFiles.name()).load(path)
