"""Listing of media files."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXTENSIONS
from ..store import stage

ENTRY = "path string, folder boolean, size bigint, mtime bigint"


def media_extension(path: Column) -> Column:
    """Whether the last extension is one of a medium; a dot file has none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1)).isin(*EXTENSIONS)


def _entries(folders: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the folders hold; folders and entries that can't be read, and links, are left out."""
    for batch in folders:
        out = []
        for folder in batch.column(0).to_pylist():
            try:
                held = list(os.scandir(folder))
            except OSError:
                continue
            for e in held:
                try:
                    found = e.stat(follow_symlinks=False)
                    e.path.encode()
                except (OSError, UnicodeEncodeError):
                    continue
                if stat.S_ISDIR(found.st_mode) or stat.S_ISREG(found.st_mode):
                    out.append((e.path, stat.S_ISDIR(found.st_mode), found.st_size, int(found.st_mtime)))
        names = ("path", "folder", "size", "mtime")
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)


def _entries_in_store(spark: SparkSession, folders: list[str]) -> list[tuple]:
    """The same for folders that only the file systems of the session can read."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            out += [(e.getPath().toString(), e.isDirectory(), e.getLen(), e.getModificationTime() // 1000) for e in fs.listStatus(path) if not e.isSymlink()]
    return out


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, size, mtime (whole seconds) of all regular files under the roots, hidden ones too; contents are not read.
    Links aren't followed, roots that aren't there give nothing. Folders are read level by level: those of a path on
    the workers (which must see it), those of other stores through the session, one level at a time."""
    own = [r.removeprefix("file:") for r in roots if "://" not in r or r.startswith("file:")]
    others, found = [r for r in roots if "://" in r and not r.startswith("file:")], spark.createDataFrame([], ENTRY)
    level = spark.createDataFrame([(os.path.normpath(r),) for r in own], "path string")
    while not level.isEmpty():
        entries = stage(level.mapInArrow(_entries, ENTRY), "listing")
        found, level = found.unionAll(entries), entries.filter("folder").select("path")
    while others:
        held = _entries_in_store(spark, others)
        found, others = found.unionAll(spark.createDataFrame(held, ENTRY)), [path for path, folder, *_ in held if folder]
    return found.filter("not folder").select("path", "size", "mtime")


def media_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    return list_files(spark, roots).filter(media_extension(F.col("path")))


def normal_path(path: Column) -> Column:
    """Component-wise equal paths become one text: '//' and '/./' collapse and a trailing slash goes."""
    once = F.regexp_replace(F.regexp_replace(path, r"/(?:\./)+", "/"), r"/{2,}", "/")
    return F.when(once == "/", once).otherwise(F.regexp_replace(once, r"(?:/\.)?/?$", ""))


def distinct_paths(files: DataFrame) -> DataFrame:
    return files.withColumn("path", normal_path(F.col("path"))).dropDuplicates(["path"])


def path_order(path: Column) -> Column:
    """Sort key by component."""
    return F.split(path, "/")
