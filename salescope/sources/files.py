"""Delimited files grouped by their own header, so that columns are found by name in each file."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: Files whose first lines are read at the same time while a plan is made.
AT_ONCE = 32


def _below(fs, status) -> list:
    """Files of a path, those of its folders included; names that begin with _ or . are not data."""
    name = status.getPath().getName()
    if name.startswith(("_", ".")):
        return []
    if status.isFile():
        return [status]
    return [f for s in fs.listStatus(status.getPath()) for f in _below(fs, s)]


def list_files(spark: SparkSession, paths: str | Iterable[str]) -> list[str]:
    """All data files of paths, globs and folders, through the Hadoop file system, in the order of their names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in [paths] if isinstance(paths, str) else [str(p) for p in paths]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        found = fs.globStatus(at)
        if not found:
            raise ValueError(f"There is no file at {path}.")
        for status in found:
            if status.isFile():
                out.append(status)
            else:
                out += [f for s in fs.listStatus(status.getPath()) for f in _below(fs, s)]
    return sorted({s.getPath().toString() for s in out if s.getLen() > 0})


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file, unpacked if its suffix names a known compression."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        source = codec.createInputStream(stream) if codec is not None else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8")).readLine()
    finally:
        stream.close()
    return (line or "").removeprefix("﻿")


def by_header(spark: SparkSession, paths: str | Iterable[str]) -> dict[str, list[str]]:
    """Files by their first line, in the order of the first file of each. Empty files are left out."""
    files = list_files(spark, paths)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), files))
    groups: dict[str, list[str]] = {}
    for line, path in zip(lines, files):
        if line.strip():
            groups.setdefault(line, []).append(path)
    return groups


def base_path(spark: SparkSession, paths: str | Iterable[str]) -> str | None:
    """The folder whose subfolders name partitions, if one folder was given."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if len(paths) != 1:
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(paths[0]))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return str(paths[0]) if fs.exists(at) and fs.getFileStatus(at).isDirectory() else None


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that a table does not have are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_groups(
    spark: SparkSession, paths: str | Iterable[str], read: Callable[[list[str], str | None], DataFrame],
) -> list[DataFrame]:
    """One table for each header: ``read`` gets the files that share it and the folder of partitions, if there is one."""
    groups = by_header(spark, paths)
    if not groups:
        raise ValueError("All files are empty: there is no header to read.")
    base = base_path(spark, paths)
    return [read(files, base) for files in groups.values()]
