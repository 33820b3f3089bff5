"""Trees and logs as data sources of Spark: `spark.read.format("kestrel_tree")`, `spark.readStream.format("kestrel_lines")`.

`register(spark)` makes both known.  A source plans its partitions from listings, takes filters on the
path into the listing (with `spark.sql.python.filterPushdown.enabled`), and reads in the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from kestrel.sources.files import SKIPPED, _store

#: Partitions that a tree is planned in, about; bytes to a batch of file contents; to a look for the end of a log's last line.
PARTS, TOGETHER, TAIL = 64, 8 << 20, 1 << 16


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    spark.dataSource.register(LinesSource)


@dataclass
class Listing(InputPartition):
    """Folders to read with all below them, and single files."""

    folders: list[str]
    files: list[str]


class TreeSource(DataSource):
    """(project, path, content, modified) of the files below `root`: project is the first folder, path is relative to the root.

    Option skip (true): folders that hold no work of their own are not entered.
    """

    @classmethod
    def name(cls) -> str:
        return "kestrel_tree"

    def schema(self) -> str:
        return "project string, path string, content string, modified timestamp"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["root"], self.options.get("skip", "true").lower() == "true")


class TreeReader(DataSourceReader):
    def __init__(self, root: str, skip: bool):
        self.root, self.skip = root, skip
        self.paths: set[str] | None = None  # the only paths that are asked for
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership and prefixes of project and path reach the listing; all stay filters of Spark's too, since names may differ in what they match."""
        for f in filters:
            match f:
                case EqualTo(("path",), value):
                    self._only({value})
                case In(("path",), values):
                    self._only(set(values))
                case EqualTo(("project",), value) if value:
                    self.prefixes.append(f"{value}/")
                case StringStartsWith((("path" | "project"),), value):
                    self.prefixes.append(value)
            yield f

    def _only(self, paths: set[str]) -> None:
        paths = {p for p in paths if p is not None}
        self.paths = paths if self.paths is None else self.paths & paths

    def _may_hold(self, folder: str) -> bool:
        """Whether a folder (relative, with a slash at its end) may hold a path that is asked for."""
        return all(folder.startswith(p) or p.startswith(folder) for p in self.prefixes)

    def _wanted(self, path: str) -> bool:
        return all(path.startswith(p) for p in self.prefixes)

    def partitions(self) -> list[Listing]:
        """Folders are opened level by level until there are enough to deal out; a prefix is followed down without a look beside it."""
        store, base = _store(self.root)
        if self.paths is not None:
            found = sorted(p for p in self.paths if self._wanted(p) and self._reaches(p.split("/")[:-1]) and p.rpartition("/")[2] not in ("", ".."))
            return [Listing([], found[i::PARTS]) for i in range(max(1, min(PARTS, len(found))))]
        start = min(self.prefixes, key=len, default="")
        for p in self.prefixes:
            if p.startswith(start):
                start = p
        folders, files, here = [], [], start.rpartition("/")[0]
        level = [here] if not here or self._reaches(here.split("/")) else []
        while level and len(folders) + len(level) < PARTS:
            below = []
            for folder in level:
                for i in self._list(store, base, folder):
                    name = i.path[len(base) + 1 :]
                    if i.type == fs.FileType.Directory:
                        if self._enters(i.base_name) and self._may_hold(f"{name}/"):
                            below.append(name)
                    elif i.type == fs.FileType.File and self._wanted(name):
                        files.append(name)
            level = below
        folders += level
        return [Listing(folders[i::PARTS], files[i::PARTS]) for i in range(PARTS) if not i or folders[i::PARTS] or files[i::PARTS]]

    def _enters(self, name: str) -> bool:
        return not self.skip or name not in SKIPPED

    def _reaches(self, folders: list[str]) -> bool:
        """Whether a walk from the root would enter all of these."""
        return ".." not in folders and all(map(self._enters, folders))

    @staticmethod
    def _list(store, base: str, folder: str) -> list:
        return store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True))

    def read(self, partition: Listing) -> Iterator[pa.RecordBatch]:
        store, base = _store(self.root)
        held, size = [], 0
        for info in self._files(store, base, partition):
            name = info.path[len(base) + 1 :]
            with store.open_input_stream(info.path, compression=None) as stream:
                content = stream.read().decode("utf-8", "replace")
            held.append({"project": name.partition("/")[0] if "/" in name else None, "path": name, "content": content, "modified": info.mtime})
            size += len(content)
            if size >= TOGETHER:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _files(self, store, base: str, partition: Listing) -> Iterator:
        for name in partition.files:
            info = store.get_file_info(f"{base}/{name}")
            if info.type == fs.FileType.File:
                yield info
        level = list(partition.folders)
        while level:
            for i in self._list(store, base, level.pop()):
                name = i.path[len(base) + 1 :]
                if i.type == fs.FileType.Directory and self._enters(i.base_name) and self._may_hold(f"{name}/"):
                    level.append(name)
                elif i.type == fs.FileType.File and self._wanted(name):
                    yield i

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = [("project", pa.string()), ("path", pa.string()), ("content", pa.string()), ("modified", pa.timestamp("us", "UTC"))]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


class LinesSource(DataSource):
    """(file, at, line): the lines that are added to the files of a folder, at what byte they begin; a line counts when its end is written.

    Options: folder; glob, a pattern on file names (*.jsonl).
    """

    @classmethod
    def name(cls) -> str:
        return "kestrel_lines"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> LinesReader:
        return LinesReader(self.options["folder"], self.options.get("glob", "*.jsonl"))


@dataclass
class Span(InputPartition):
    file: str
    start: int
    stop: int


class LinesReader(DataSourceStreamReader):
    """Offsets are the bytes read of each file; a file that became shorter is a new one and is read from its start."""

    def __init__(self, folder: str, glob: str):
        self.folder = folder
        self.pattern = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the last whole line of each file: only tails are looked at."""
        store, base = _store(self.folder)
        out = {}
        for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if i.type == fs.FileType.File and self.pattern.fullmatch(i.base_name):
                out[i.base_name] = self._last_end(store, i.path, i.size)
        return dict(sorted(out.items()))

    @staticmethod
    def _last_end(store, path: str, size: int) -> int:
        with store.open_input_file(path) as file:
            stop = size
            while stop > 0:
                start = max(0, stop - TAIL)
                at = file.read_at(stop - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                stop = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = []
        for file, stop in end.items():
            first = start.get(file, 0)
            first = 0 if first > stop else first
            if stop > first:
                spans.append(Span(file, first, stop))
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        store, base = _store(self.folder)
        with store.open_input_file(f"{base}/{partition.file}") as file:
            at, rest = partition.start, b""
            read = at
            while read < partition.stop:
                data = rest + file.read_at(min(TOGETHER, partition.stop - read), read)
                read = min(read + TOGETHER, partition.stop)
                *whole, rest = data.split(b"\n")
                for line in whole:
                    yield partition.file, at, line.decode("utf-8", "replace").removesuffix("\r")
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass

