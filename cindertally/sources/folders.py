"""A Spark data source of text files below folders whose levels are columns, e.g. split/site/name.txt.

A filter on levels (equality, membership) is applied while the folders are listed, so that only those it
leaves are opened: at 10^6 sites a query of one lists one. A folder of the last level is a partition,
or several where it holds many files. Spark passes filters to Python sources only if
spark.sql.python.filterPushdown.enabled is true, and refuses readers that take filters otherwise, so
that `labelled_folders` sets it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Files of a partition at most.
FILES = 256


@dataclass
class Files(InputPartition):
    """Some files of one folder, and its levels."""

    levels: tuple[str, ...]
    paths: tuple[str, ...]


class FolderReader(DataSourceReader):
    def __init__(self, root: str, levels: Sequence[str], suffixes: Sequence[str]):
        self.root, self.levels, self.suffixes = root, list(levels), tuple(s.lower() for s in suffixes)
        self.only: dict[str, set] = {}
        self.listed: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of levels; gives back the rest."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in self.levels:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f

    def opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def partitions(self) -> list[Files]:
        system, root = self.opened()
        out: list[Files] = []

        def walk(path: str, above: tuple[str, ...]) -> None:
            self.listed.append(path)
            inside = sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path)
            if len(above) == len(self.levels):
                files = [x.path for x in inside if x.is_file and x.base_name.lower().endswith(self.suffixes)]
                out.extend(Files(above, tuple(files[k : k + FILES])) for k in range(0, len(files), FILES))
                return
            wanted = self.only.get(self.levels[len(above)])
            for x in inside:
                if x.type == fs.FileType.Directory and (wanted is None or x.base_name in wanted):
                    walk(x.path, (*above, x.base_name))

        walk(root, ())
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self.opened()
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                text = f.read().decode()
            values = [[x] for x in (*partition.levels, path, text)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in values], [*self.levels, "path", "value"])


class FolderSource(DataSource):
    """Options: path, levels (names, comma between), suffixes (comma between)."""

    @classmethod
    def name(cls) -> str:
        return "labelled_folders"

    def parted(self, option: str) -> list[str]:
        return [x for x in self.options.get(option, "").split(",") if x]

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in (*self.parted("levels"), "path", "value"))

    def reader(self, schema: object) -> FolderReader:
        return FolderReader(self.options["path"], self.parted("levels"), self.parted("suffixes") or [""])


def labelled_folders(spark: SparkSession, path: str, levels: Sequence[str], suffixes: Sequence[str] = (".txt",)) -> DataFrame:
    """The levels, path and text of each file below path; the path is one that pyarrow opens (local, HDFS, object stores)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    uri = path if "://" in path or path.startswith("/") else f"/{path}"
    return spark.read.format("labelled_folders").option("levels", ",".join(levels)).option("suffixes", ",".join(suffixes)).load(uri)
