"""Listing folders in tasks, level by level, and files reached from tasks."""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions.paths import ASIDE
from lumisift.sources.tables import qualified, shuffle_partitions, written

FOUND = "path string, uri string, folder boolean, hidden boolean, length long, modificationTime timestamp"


def file_system(uri: str):
    """pyarrow's file system of a Hadoop path, and the path in it."""
    from pyarrow import fs

    scheme, rest = uri.split(":", 1)
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def reader(uri: str):
    """read(at, n) of the file at a Hadoop path, by ranges; and what closes it."""
    files, place = file_system(uri)
    opened = files.open_input_file(place)
    size = opened.size()

    def read(at: int, n: int) -> bytes:
        return opened.read_at(min(n, size - at), at) if 0 <= at < size and n > 0 else b""

    return read, opened.close


def encoded(path: str) -> str:
    """A path as URIs have it: all but what they allow, and letters beyond ASCII, in percent form."""
    return re.sub(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=/@¡-\U0010ffff]", lambda m: quote(m[0], safe=""), path)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, uri, hidden, length, modificationTime) of all files at any depth below root, whatever their names.

    Folders are listed by tasks, all of one depth at a time; only whether there are deeper ones comes to the driver.
    Folders named 'disqualified' (but for root) are left out, those that can't be read are skipped. hidden: the
    file, or a folder between it and root, has a name that Spark's file sources leave out.
    """
    base, base_uri = qualified(spark, root)
    n = shuffle_partitions(spark)

    def listed(frames):
        from pyarrow import fs

        for frame in frames:
            out = []
            for folder, below in zip(frame["path"], frame["hidden"], strict=True):
                files, place = file_system(folder)
                try:
                    inside = files.get_file_info(fs.FileSelector(place))
                except OSError:
                    continue
                for x in inside:
                    if x.type in (fs.FileType.File, fs.FileType.Directory):
                        path = f"{folder}/{x.base_name}"
                        out.append((path, base_uri + encoded(path[len(base) :]), x.type == fs.FileType.Directory, below or x.base_name[0] in "_.", x.size, x.mtime))
            yield pd.DataFrame(out, columns=["path", "uri", "folder", "hidden", "length", "modificationTime"])

    folders, levels = spark.createDataFrame([(base, False)], "path string, hidden boolean"), []
    while not levels or not folders.isEmpty():
        level = written(folders.repartition(n).mapInPandas(listed, FOUND))
        levels.append(level.filter("NOT folder").drop("folder"))
        folders = level.filter("folder").filter(~F.col("path").rlike(f"/{ASIDE}$")).select("path", "hidden")
    found = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    return found
