"""Loaders by key, and a Python Data Source for frame listings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from gridspark.sources import index as I

LOADERS: dict[str, Callable[..., DataFrame]] = {
    "void_stairs": I.sequence_index, "minjiang": I.scene_camera_index, "ours": I.numbered_shot_index, "hammer": I.trajectory_index,
    "arkitscenes": I.triple_index, "hypersim": I.camera_frame_index, "nyuv2": I.positional_index, "middlebury": I.paired_index,
    "lu": I.paired_index, "rgbd_stair": I.ranged_index,
}
# Configuration keys that only document a dataset.
DOC_KEYS = ("docs", "notes", "url")


def build_index(key: str, files: DataFrame, *args, **config) -> DataFrame:
    """Index of a dataset by loader key; documentation keys are dropped."""
    if key not in LOADERS:
        raise KeyError(f"unknown loader {key!r}; known: {sorted(LOADERS)}")
    return LOADERS[key](files, *args, **{k: v for k, v in config.items() if k not in DOC_KEYS})


class _Folder(InputPartition):
    def __init__(self, path: str, sequence: str, deep: bool):
        self.path, self.sequence, self.deep = path, sequence, deep


class _ListingReader(DataSourceReader):
    """One partition per top directory that the pushed filters on ``sequence`` leave."""

    def __init__(self, root: str):
        self.root, self.wanted, self.prefixes = root, None, []

    def pushFilters(self, filters):
        for f in filters:
            of = getattr(f, "attribute", None)
            if of == ("sequence",) and isinstance(f, EqualTo):
                self._only({f.value})
            elif of == ("sequence",) and isinstance(f, In):
                self._only(set(f.value))
            elif of == ("sequence",) and isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            else:
                yield f  # left to Spark

    def _only(self, names: set) -> None:
        self.wanted = names if self.wanted is None else self.wanted & names

    def _keeps(self, name: str) -> bool:
        return (self.wanted is None or name in self.wanted) and all(name.startswith(p) for p in self.prefixes)

    def partitions(self):
        fs, root = FileSystem.from_uri(self.root)
        found = sorted(fs.get_file_info(FileSelector(root)), key=lambda i: i.path)
        tops = [_Folder(i.path, i.base_name, True) for i in found if i.type == FileType.Directory and self._keeps(i.base_name)]
        loose = [_Folder(root, "", False)] if self._keeps("") and any(i.type == FileType.File for i in found) else []
        return tops + loose or [_Folder("", "", False)]

    def read(self, partition) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, root = FileSystem.from_uri(self.root)
        for i in sorted(fs.get_file_info(FileSelector(partition.path, recursive=partition.deep)), key=lambda i: i.path):
            if i.type == FileType.File:
                yield partition.sequence, i.path[len(root.rstrip("/")) + 1:], i.size


class FrameListing(DataSource):
    """``spark.read.format("frame_listing").load(root)``: sequence (top directory), path under the root, length.

    The driver lists the root alone; each top directory is walked by a task of its own, and a filter
    on ``sequence`` (equal, in, starts with) leaves only the directories that it names. Files right
    under the root have an empty sequence. Any address that pyarrow's file systems open will do.
    """

    @classmethod
    def name(cls) -> str:
        return "frame_listing"

    def schema(self) -> str:
        return "sequence string, path string, length bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        root = self.options["path"]
        return _ListingReader(root if ":/" in root else f"file://{root}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameListing)


def list_frames(spark: SparkSession, root: str) -> DataFrame:
    """The listing with filters pushed to it."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("frame_listing").load(root)
