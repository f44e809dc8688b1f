"""Objects under keys: the raw file, its markdown and its record, put by tasks and made visible by the job's commit.

A Python data source writes them. Every task puts its objects, numbered, and the list of their keys below a folder of its own
attempt. The driver's commit names the attempts that succeeded and nothing else; tasks then move what these wrote to its keys, and
an aborted job or attempt leaves none. An object that is there already is replaced. Objects are read back by their keys, or listed
folder by folder, in tasks as well: the driver holds no keys. Any store with a pyarrow file system will do.
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lamplight import session

SCHEMA = "key string, content binary"
PENDING = "_pending"
#: Bytes of objects that a task hands on at a time.
BATCH_BYTES = 4 << 20


def checked_key(key: str) -> str:
    """A key is a relative path without empty, ``.`` or ``..`` parts, and not among what is pending."""
    parts = (key or "").split("/")
    if not key or any(p in ("", ".", "..") for p in parts) or parts[0] == PENDING:
        raise ValueError(f"not an object key: {key!r}")
    return key


def file_system(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store of ``root`` and the path in it."""
    if "://" not in root:
        root = root.removeprefix("file:")
        return arrow_fs.LocalFileSystem(), posixpath.normpath(root)
    return arrow_fs.FileSystem.from_uri(root)


@dataclass
class Put(WriterCommitMessage):
    """The folder of one attempt: it holds the objects by number, and their keys line by line."""

    attempt: str


class ObjectWriter(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator: Iterator) -> Put:
        store, base = file_system(self.root)
        attempt = f"{base}/{PENDING}/{self.job}/{uuid4().hex}"
        store.create_dir(attempt, recursive=True)
        try:
            with store.open_output_stream(f"{attempt}/keys") as keys:
                for number, row in enumerate(iterator):
                    key = checked_key(row["key"])
                    with store.open_output_stream(f"{attempt}/{number}") as out:
                        out.write(bytes(row["content"] or b""))
                    keys.write(json.dumps(key).encode() + b"\n")
        except BaseException:
            if _there(store, attempt):
                store.delete_dir(attempt)
            raise
        return Put(attempt)

    def commit(self, messages: list) -> None:
        store, base = file_system(self.root)
        store.create_dir(f"{base}/{PENDING}/{self.job}", recursive=True)
        with store.open_output_stream(f"{base}/{PENDING}/{self.job}/attempts") as out:
            out.write("\n".join(put.attempt for put in messages if put).encode())

    def abort(self, messages: list) -> None:
        clear(self.root, self.job)


def _there(store: arrow_fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != arrow_fs.FileType.NotFound


def clear(root: str, job: str) -> None:
    """Deletes what is pending of a job."""
    store, base = file_system(root)
    if _there(store, f"{base}/{PENDING}/{job}"):
        store.delete_dir(f"{base}/{PENDING}/{job}")


def _published(root: str, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Moves the objects of attempts to their keys; a task that is run again goes on where the first one stopped."""
    store, base = file_system(root)
    for part in parts:
        moved, made = 0, set()
        for attempt in part["attempt"]:
            with io.BufferedReader(store.open_input_file(f"{attempt}/keys")) as keys:
                for number, line in enumerate(keys):
                    path, pending = f"{base}/{json.loads(line)}", f"{attempt}/{number}"
                    folder = posixpath.dirname(path)
                    if folder not in made:
                        made = {folder}
                        store.create_dir(folder, recursive=True)
                    try:
                        store.move(pending, path)
                    except OSError:
                        if _there(store, pending) or not _there(store, path):
                            raise
                    moved += 1
        yield pd.DataFrame({"moved": [moved]})


class ObjectStore(DataSource):
    """``df.write.format("objects").option("job", job).save(root)`` leaves rows of (key, content) pending; ``put`` publishes them."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["path"], self.options["job"])


def put(rows: DataFrame, root: str) -> None:
    """Writes the objects; of rows with one key the greatest content stays, so that a repeated run leaves the same."""
    spark = rows.sparkSession
    spark.dataSource.register(ObjectStore)
    one = rows.select("key", F.col("content").cast("binary").alias("content")).groupBy("key").agg(F.max("content").alias("content"))
    job = uuid4().hex
    one.write.format("objects").mode("append").option("path", root).option("job", job).save()
    store, base = file_system(root)
    with store.open_input_file(f"{base}/{PENDING}/{job}/attempts") as lines:
        attempts = lines.read().decode().split()
    if attempts:
        pending = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(len(attempts))
        pending.mapInPandas(lambda parts: _published(root, parts), "moved long").agg(F.sum("moved")).collect()
    clear(root, job)


def fetch(rows: DataFrame, root: str, key: str = "key") -> DataFrame:
    """``rows`` with the ``content`` of the object under each key, null where there is none."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)
        for part in parts:
            at, held, size = 0, [], 0
            for name in part.column(key).to_pylist():
                try:
                    with store.open_input_file(f"{base}/{checked_key(name)}") as found:
                        held.append(found.read())
                except FileNotFoundError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= BATCH_BYTES or at + len(held) == part.num_rows:
                    yield part.slice(at, len(held)).append_column("content", pa.array(held, pa.binary()))
                    at, held, size = at + len(held), [], 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(read, f"{fields}, content binary")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(key, size) of the objects under ``root``, listed level by level of folders, the folders of a level by tasks."""

    def entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = file_system(root)
        for part in parts:
            for folder in part["key"]:
                found = store.get_file_info(arrow_fs.FileSelector(f"{base}/{folder}", allow_not_found=True))
                for at in range(0, len(found), 10_000):
                    rows = [(i.path[len(base) + 1 :], i.type == arrow_fs.FileType.Directory, i.size or 0) for i in found[at : at + 10_000]]
                    yield pd.DataFrame([r for r in rows if r[0] != PENDING], columns=["key", "folder", "size"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folders = spark.createDataFrame([("",)], "key string")
    found = spark.createDataFrame([], SCHEMA.replace("content binary", "size long"))
    while True:
        level = session.stored(folders.mapInPandas(entries, "key string, folder boolean, size long"), "objects-listed")
        found = found.unionByName(level.filter("NOT folder").select("key", "size"))
        folders = level.filter("folder").select("key").repartition(tasks)
        if folders.isEmpty():
            return found


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(key, content) of the objects under ``root``, empty ones left out."""
    return fetch(listed(spark, root).filter("size > 0").select("key"), root)
