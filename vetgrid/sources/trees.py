"""Source trees in a file system.

Spark's own file sources leave out every name that starts with ``_`` or ``.``, which in source
trees are ordinary files (package markers, environment files, ignore files). Trees on a mounted
file system, or on one that Arrow can open, are therefore walked and read by tasks, one level of folders after the other; nothing
but the fact that a level is empty reaches the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.functions.text import utf8
from vetgrid.session import stage_table
from vetgrid.sources.files import is_binary

# Folders that neither the scan nor the search for server imports looks into.
PRUNED_FOLDERS = ("__pycache__", ".venv", "venv", "node_modules", ".git", ".tox", ".mypy_cache")

_ENTRY = "path STRING, is_folder BOOLEAN, size BIGINT"
_BATCH_BYTES = 16 << 20
_TASK_BYTES = 128 << 20


def read_tree(spark: SparkSession, root: str, *, max_file_kb: int | None = None) -> DataFrame:
    """All files below ``root``, or those up to a size: ``(path, rel_path, content, size, is_binary)``.

    ``root`` is a folder that every executor sees, or a URL of a file system that Arrow knows (``file``,
    ``s3``, ``gs``, ``abfs``, ``hdfs``); hidden and empty files are found in all of them, level by level of the
    tree. For any other scheme Spark's binary source is used; it does not see names that start with
    ``_`` or ``.`` and no empty files, so load such trees into a table first if these matter.
    """
    if "://" not in root:
        root = os.path.abspath(root)
        raw = _read_mounted(spark, root, max_file_kb)
    elif _known_to_arrow(root):
        root = root.rstrip("/")
        raw = _read_mounted(spark, root, max_file_kb)
    else:
        raw = _read_objects(spark, root, max_file_kb)
    base = root.rstrip("/") + "/"
    path, content = F.col("path"), F.col("content")
    return raw.select(
        "path",
        F.when(F.startswith(path, F.lit(base)), F.expr(f"substr(path, {len(base) + 1})"))
        .otherwise(path).alias("rel_path"),
        utf8(content).alias("content"),
        "size",
        is_binary(content).alias("is_binary"),
    )


def _read_objects(spark: SparkSession, root: str, max_file_kb: int | None) -> DataFrame:
    # A filter on the length reaches the source, which then opens no larger file.
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .filter(_within(F.col("length"), max_file_kb))
        .select("path", "content", F.col("length").alias("size"))
    )


def _within(size: Column, max_file_kb: int | None) -> Column:
    return F.lit(True) if max_file_kb is None else size <= max_file_kb * 1024


def _read_mounted(spark: SparkSession, root: str, max_file_kb: int | None) -> DataFrame:
    chosen = list_tree(spark, root).filter(_within(F.col("size"), max_file_kb))
    total = chosen.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return _spread(chosen.select("path"), total // _TASK_BYTES).mapInPandas(
        _read_files, "path STRING, content BINARY, size BIGINT")


def _known_to_arrow(url: str) -> bool:
    try:
        _opened(url)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def _opened(url: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a URL, the path in it, and what stands before that path in URLs. Names are not encoded."""
    scheme, rest = url.split("://", 1)
    system, path = fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return system, path, url[: len(url) - len(path)] if url.endswith(path) else f"{scheme}://"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size)`` of all files below a mounted folder or a URL that Arrow knows."""
    level = spark.createDataFrame([(root,)], "path STRING")
    files = spark.createDataFrame([], "path STRING, size BIGINT")
    while True:
        entries = stage_table(_spread(level, 0).mapInPandas(_list_folders, _ENTRY), "tree")
        files = files.unionByName(entries.filter("NOT is_folder").select("path", "size"))
        level = entries.filter("is_folder").select("path")
        if level.isEmpty():
            return files


def _spread(paths: DataFrame, tasks: int) -> DataFrame:
    """Paths over at least ``tasks`` tasks and all cores.

    The number is given, because sized by their own bytes the paths would end up in one task.
    """
    cores = paths.sparkSession.sparkContext.defaultParallelism
    return paths.repartition(max(cores * 2, tasks + 1), "path")


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder in batch["path"]:
            rows = []
            if "://" in folder:
                yield pd.DataFrame(_entries(folder), columns=["path", "is_folder", "size"])
                continue
            try:
                with os.scandir(folder) as entries:
                    for entry in entries:
                        if entry.is_dir(follow_symlinks=False):
                            if entry.name not in PRUNED_FOLDERS:
                                rows.append((entry.path, True, 0))
                        elif entry.is_file():
                            rows.append((entry.path, False, entry.stat().st_size))
            except PermissionError:
                continue
            yield pd.DataFrame(rows, columns=["path", "is_folder", "size"])


def _entries(folder: str) -> list[tuple[str, bool, int]]:
    system, path, before = _opened(folder)
    rows = []
    for entry in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if entry.type == fs.FileType.Directory:
            if entry.base_name not in PRUNED_FOLDERS:
                rows.append((before + entry.path, True, 0))
        elif entry.type == fs.FileType.File:
            rows.append((before + entry.path, False, entry.size))
    return rows


def _content(path: str) -> bytes:
    if "://" not in path:
        with open(path, "rb") as stream:
            return stream.read()
    system, inside, _ = _opened(path)
    with system.open_input_stream(inside) as stream:
        return stream.read()


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "content", "size"]
    rows, held = [], 0
    for batch in batches:
        for path in batch["path"]:
            try:
                data = _content(path)
            except OSError:
                continue
            rows.append((path, data, len(data)))
            held += len(data)
            if held >= _BATCH_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
    yield pd.DataFrame(rows, columns=columns)
