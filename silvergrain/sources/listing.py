"""Folder trees as tables: listed level by level by Spark tasks, never on the driver.

Each round lists the folders found by the round before, spread over tasks, and
writes what it finds, so a lost executor costs a round's tasks at most. Private
folders are not entered. Any store that Arrow reaches will do. A folder that
vanishes meanwhile is empty, and links to folders are not followed.
"""
from __future__ import annotations

import os
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvergrain.session import cut_lineage, ship_package

FOUND = "source string, root string, rel_path string, is_folder boolean, file_size long, mtime long"
#: Entries of one output batch.
BATCH = 10_000


def _entries(source: str, root: str, folder: str, private: str):
    store, inner = fs.FileSystem.from_uri(root)
    inner = inner.rstrip("/")
    for info in store.get_file_info(fs.FileSelector(f"{inner}/{folder}" if folder else inner, allow_not_found=True)):
        is_folder = info.type == fs.FileType.Directory
        if is_folder and (info.base_name.startswith(private) or (
                isinstance(store, fs.LocalFileSystem) and os.path.islink(info.path))):
            continue
        if is_folder or info.type == fs.FileType.File:
            yield (source, root, f"{folder}/{info.base_name}" if folder else info.base_name, is_folder,
                   None if is_folder else info.size, None if info.mtime_ns is None else info.mtime_ns // 10**9)


def _listed(batches, private: str):
    schema = pa.schema([("source", pa.string()), ("root", pa.string()), ("rel_path", pa.string()), ("is_folder", pa.bool_()),
                        ("file_size", pa.int64()), ("mtime", pa.int64())])
    held: list[tuple] = []

    def flushed():
        columns = list(zip(*held)) if held else [()] * len(schema)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        for source, root, folder in zip(*[column.to_pylist() for column in batch.columns]):
            for entry in _entries(source, root, folder, private):
                held.append(entry)
                if len(held) == BATCH:
                    yield flushed()
                    held.clear()
    yield flushed()


def list_tree(spark: SparkSession, roots: dict[str, str], tasks: int = 64, private: str = "_") -> DataFrame:
    """Files below the roots as ``source, rel_path, file_size, mtime``; ``roots`` gives each source's folder.

    One written table for each level of the tree, with as many tasks as ``tasks`` says.
    """
    ship_package(spark)
    folders = spark.createDataFrame([(name, path, "") for name, path in roots.items()],
                                    "source string, root string, folder string")
    levels: list[DataFrame] = []
    while not levels or not folders.isEmpty():
        spread = folders.repartition(tasks, "source", "folder").select("source", "root", "folder")
        level = cut_lineage(spread.mapInArrow(lambda batches: _listed(batches, private), FOUND))
        levels.append(level)
        folders = level.where("is_folder").withColumnRenamed("rel_path", "folder")
    return reduce(DataFrame.unionByName, levels).where("NOT is_folder").select("source", "rel_path", "file_size", "mtime")


def write_tree(files: DataFrame, root: str) -> int:
    """Writes rows of ``rel_path, content`` as files below ``root`` from Spark tasks; gives their number.

    A retried task writes the same files again.
    """
    def written(batches):
        store, inner = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        count = 0
        for batch in batches:
            for path, content in zip(*[column.to_pylist() for column in batch.columns]):
                full = f"{inner}/{path}"
                folder = os.path.dirname(full)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(full) as out:
                    out.write(content)
                count += 1
        yield pa.record_batch({"written": pa.array([count], pa.int64())})

    rows = files.select("rel_path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(written, "written long").agg(F.sum("written")).first()[0] or 0
