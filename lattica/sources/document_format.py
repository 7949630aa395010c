"""Folders of documents as a data source: `spark.read.format("documents")`, and the same as a stream.

Files are planned by size into tasks, opened where a task runs and decoded once.
A file that cannot be read is a row with its reason, beside those that can.

Paths are local ones or URIs of stores that pyarrow reaches; what only Spark's
own readers reach goes through `files.list_files` and `files.parsed_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lattica.sources.files import DECODERS, PARSED, TYPE_OF_SUFFIX, Decoder, decoded_row

BYTES_PER_TASK = 64 << 20
FILES_PER_TASK = 1000


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass(frozen=True)
class _Found:
    path: str
    size: int
    modified: int  # nanoseconds


class _Folder:
    """What both readers share: listing, planning and reading."""

    def __init__(self, options: dict[str, str], decoders: dict[str, Decoder]):
        options = {k.lower(): v for k, v in options.items()}
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.pattern = options["path"], options.get("pathglobfilter", "*")
        self.recursive = options.get("recursivefilelookup", "true").lower() == "true"
        self.bytes = int(options.get("bytespertask", BYTES_PER_TASK))
        self.decoders = decoders

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)

    def found(self) -> list[_Found]:
        from pyarrow import fs

        store, root = self._store()
        chosen = fs.FileSelector(root, recursive=self.recursive)
        listed = [f for f in store.get_file_info(chosen) if f.type == fs.FileType.File]
        # Names that start with a dot or an underscore are other programs' work in progress.
        kept = [f for f in listed if fnmatch(f.base_name, self.pattern) and f.base_name[0] not in "._"]
        return sorted((_Found(f.path, f.size or 0, f.mtime_ns or 0) for f in kept), key=lambda f: f.path)

    def planned(self, files: list[_Found]) -> list[Files]:
        """Tasks of about `bytes` each; a larger file is a task's main work."""
        total = sum(f.size for f in files)
        tasks = max(-(-total // self.bytes), -(-len(files) // FILES_PER_TASK), 1)
        loads: list[list[str]] = [[] for _ in range(min(tasks, max(len(files), 1)))]
        for n, f in enumerate(sorted(files, key=lambda f: (-f.size, f.path))):
            # By size in turns, forwards and backwards, which keeps sums close without a heap.
            turn, place = divmod(n, len(loads))
            loads[place if turn % 2 == 0 else -1 - place].append(f.path)
        return [Files(tuple(paths)) for paths in loads if paths]

    def rows(self, task: Files) -> Iterator[tuple]:
        store, _ = self._store()
        for path in task.paths:
            kind = TYPE_OF_SUFFIX.get(path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "", "unknown")
            try:
                with store.open_input_stream(path) as stream:
                    data = stream.read()
            except OSError as problem:
                yield decoded_row(path, kind, None, self.decoders, f"{type(problem).__name__}: {problem}")
            else:
                yield decoded_row(path, kind, data, self.decoders)


class _BatchReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.planned(self.found())

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class _StreamReader(_Folder, DataSourceStreamReader):
    """New files by (time of change, path); a file that appears with an earlier time than one already read is missed."""

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        newest = max(((f.modified, f.path) for f in self.found()), default=(-1, ""))
        return {"modified": newest[0], "path": newest[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["modified"], o["path"]) for o in (start, end))
        return self.planned([f for f in self.found() if low < (f.modified, f.path) <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to forget: offsets alone tell what has been read."""


def document_format(extra_decoders: dict[str, Decoder] | None = None, name_: str = "documents") -> type[DataSource]:
    """The data source, with decoders for further file types."""
    decoders = {**DECODERS, **(extra_decoders or {})}

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return PARSED

        def reader(self, schema) -> DataSourceReader:
            return _BatchReader(dict(self.options), decoders)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(dict(self.options), decoders)

    return Documents


def register(spark: SparkSession, extra_decoders: dict[str, Decoder] | None = None) -> None:
    """Make `spark.read.format("documents")` and `spark.readStream.format("documents")` known to the session."""
    spark.dataSource.register(document_format(extra_decoders))

