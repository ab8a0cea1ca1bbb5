"""Connectors: places that files are listed from, as data sources that Spark plans scans of.

A connector is a class registered here by name, and ``listing`` reads one. What
is wanted of it by parent folder, MIME type or name is best said to ``listing``:
folders that aren't wanted are never opened. With the option ``pushdown`` the
same is taken from the filters of a query. Scans of one ``load`` share what was
pushed last (Spark 4.1), so then each frame is good for one filter; without the
option nothing is shared.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Entries in a page of a listing (fixed value of the source's API).
PAGE = 100
FOLDER = "application/vnd.google-apps.folder"
ENTRIES = "id string, name string, mime string, target_id string, target_mime string, size long, parent_id string, page int"
#: The directory of entries without a parent; others are named by an x and the hexadecimal digits of the parent's id.
TOP = "top"
#: Columns that a listing is asked by.
ASKED = ("parent_id", "mime", "name")


class Folder(InputPartition):
    """A folder's file of entries, to be read page by page."""

    def __init__(self, parent: str | None, path: str):
        super().__init__(path)
        self.parent, self.path = parent, path


class DriveReader(DataSourceReader):
    """Pages of the folders that are wanted: one partition for each file that a folder has."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.pushdown = options["path"], options.get("pushdown", "false").lower() == "true"
        self.wanted: dict[str, list] = {name: json.loads(options[name]) for name in ASKED if name in options}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name not in ASKED or not self.pushdown:
                yield f
            elif name in self.wanted:
                self.wanted[name] = [v for v in self.wanted[name] if v in values]
            else:
                self.wanted[name] = values

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def partitions(self) -> list[Folder]:
        store, root = self._store()
        asked = self.wanted.get("parent_id")
        places = [root] if asked is None else [f"{root}/folder=x{p.encode().hex().upper()}" for p in dict.fromkeys(asked) if p is not None]
        found = []
        for place in places:
            for info in store.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True)):
                if info.type == fs.FileType.File and info.path.endswith(".parquet"):
                    code = info.path.split("/")[-2].removeprefix("folder=")
                    found.append(Folder(None if code == TOP else bytes.fromhex(code[1:]).decode(), info.path))
        return sorted(found, key=lambda f: f.path)

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no folder is left
            return
        store, _ = self._store()
        page = 0
        with pq.ParquetFile(partition.path, filesystem=store) as file:
            for batch in file.iter_batches(batch_size=PAGE):  # trashed entries never were listed
                n = len(batch)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "name", "mime", "target_id", "target_mime", "size")]
                out = pa.RecordBatch.from_arrays(
                    [*columns, pa.array([partition.parent] * n, pa.string()), pa.array([page] * n, pa.int32())],
                    names=["id", "name", "mime", "target_id", "target_mime", "size", "parent_id", "page"],
                )
                for name in ("mime", "name"):
                    if name in self.wanted:
                        out = out.filter(pc.is_in(out.column(name), pa.array(self.wanted[name], pa.string())))
                page += 1
                if len(out):
                    yield out


class Drive(DataSource):
    """A drive's folders as ``write_drive`` lays them out.

    Options: ``path`` names the drive; ``parent_id``, ``mime`` and ``name`` hold JSON
    lists of wanted values; ``pushdown`` takes such values from a query's filters.
    """

    @classmethod
    def name(cls) -> str:
        return "drive"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DriveReader:
        if "path" not in self.options:
            raise ValueError("option path must name a drive")
        return DriveReader(self.options)


_CONNECTORS: dict[str, type[DataSource]] = {}


def register_connector(cls: type[DataSource], name: str | None = None) -> None:
    """Makes a connector known by its own name or another."""
    _CONNECTORS[name or cls.name()] = cls


def connector_class(name: str) -> type[DataSource]:
    if name not in _CONNECTORS:
        raise ValueError(f"Unknown source connector: {name!r}")
    return _CONNECTORS[name]


def connectors() -> dict[str, type[DataSource]]:
    return dict(_CONNECTORS)


register_connector(Drive)


def listing(spark: SparkSession, connector: str, wanted: dict[str, list] | None = None, **options: str) -> DataFrame:
    """What a connector lists, of the wanted values of parent_id, mime and name only; unknown names of connectors raise."""
    cls = connector_class(connector)
    if extra := set(wanted or {}) - set(ASKED):
        raise ValueError(f"a listing can't be asked by {sorted(extra)}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # readers without the option push nothing
    spark.dataSource.register(cls)
    return spark.read.format(cls.name()).options(**options, **{k: json.dumps(v) for k, v in (wanted or {}).items()}).load()


def write_drive(entries: DataFrame, uri: str) -> None:
    """Entries (id, parent_id, name, mime, target_id, target_mime, trashed, size) as a drive: a directory a folder.

    A folder's entries stand in listing order, folders first, then by name; a
    large folder has several files, each a part of that order. Trashed entries
    aren't listed.
    """
    folder = F.coalesce(F.concat(F.lit("x"), F.hex(F.encode("parent_id", "utf-8"))), F.lit(TOP)).alias("folder")
    order = ["folder", (F.col("mime") != FOLDER).cast("int"), "name", "id"]
    held = entries.where("not coalesce(trashed, false)").select(folder, "id", "name", "mime", "target_id", "target_mime", F.col("size").cast("long").alias("size"))
    held.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("folder").parquet(uri)
