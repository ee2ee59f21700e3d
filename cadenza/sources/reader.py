"""Score files as a data source: ``spark.read.format("scores").load(path)``.

Each file is a task's piece of work and streams through the parser: a measure's rows go out when it closes, and its elements are
dropped with it, so memory does not grow with the file. A file that breaks off has the rows up to there and one last row of kind
``error``; ``whole`` leaves out such files.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scores import COLUMNS, EVENTS, streamed


class ScoreFile(InputPartition):
    def __init__(self, path: str, uri: str):
        self.path, self.uri = path, uri


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self._path = path

    def partitions(self) -> list[ScoreFile]:
        """One for each file under the path, hidden ones left out, in order of names."""
        system, at = fs.FileSystem.from_uri(self._path if "://" in self._path else f"file://{self._path}")
        found = system.get_file_info(at)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        return [ScoreFile(f.path, self._path) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]

    def read(self, partition: ScoreFile) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(partition.uri if "://" in partition.uri else f"file://{partition.uri}")
        with system.open_input_stream(partition.path) as stream:
            for row in streamed(partition.path, stream):
                yield tuple(row.get(c) for c in COLUMNS)


class ScoreFiles(DataSource):
    """Rows of EVENTS; ``doc`` is the file's path."""

    @classmethod
    def name(cls) -> str:
        return "scores"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """EVENTS of every file under ``path``, those of broken files among them."""
    spark.dataSource.register(ScoreFiles)
    return spark.read.format("scores").load(path)


def whole(events: DataFrame) -> DataFrame:
    """``events`` without the rows of files that have an error, but for the error itself."""
    broken = events.where("kind = 'error'").select("doc").distinct()
    return events.join(broken, "doc", "left_anti").unionByName(events.where("kind = 'error'"))
