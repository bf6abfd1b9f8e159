"""Object listing (S4) as a Spark data source, zero-length objects included.

``binaryFile`` leaves empty files out, so there "empty" and "missing" look alike.  This source asks the store itself
(``pyarrow.fs``: local folders, HDFS, S3, GCS): the driver lists the first level, every folder found there is one
input partition, and a task lists what lies below it.  No object is opened.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key string, size long, modified timestamp"


def store_of(root: str):
    """(file system, path in it) of a folder or URI."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class ListingReader(DataSourceReader):
    def __init__(self, root: str, hidden: bool):
        self.root, self.hidden = root.rstrip("/"), hidden

    def infos(self, below: str, recursive: bool) -> list:
        from pyarrow import fs
        store, base = store_of(self.root)
        return store.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{below}".rstrip("/"), recursive=recursive, allow_not_found=True))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs
        top = self.infos("", recursive=False)
        folders = sorted(i.base_name for i in top if i.type == fs.FileType.Directory)
        # objects of the first level itself are one more partition
        return [InputPartition(None), *[InputPartition(name) for name in folders]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs
        _, base = store_of(self.root)
        below = partition.value
        for info in self.infos(below or "", recursive=below is not None):
            key = info.path[len(base.rstrip("/")) + 1:]
            if info.type == fs.FileType.File and (self.hidden or not any(part[0] in "._" for part in key.split("/"))):
                yield key, info.size, info.mtime


class Listing(DataSource):
    """``spark.read.format("reelspark_listing").load(root)``; option ``hidden=true`` lists names that begin with ``.`` or ``_`` too."""

    @classmethod
    def name(cls) -> str:
        return "reelspark_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"], self.options.get("hidden", "false").lower() == "true")


def listing(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """``key`` (path below ``root``), ``size``, ``modified`` of every object, empty ones too; a missing folder has none."""
    spark.dataSource.register(Listing)
    return spark.read.format("reelspark_listing").option("hidden", str(hidden).lower()).load(root)
