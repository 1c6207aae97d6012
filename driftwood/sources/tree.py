"""A folder tree as a Spark data source: folders that are left out are not entered, files that are left out are not opened.

    spark.dataSource.register(FolderTree)
    spark.read.format("folder_tree").option("path", "/data").load()

For trees that the driver and all executors see under one path.  Stores that only Spark reads have `files.listing` and
`files.contents`.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftwood.sources.files import EXTENSIONS, HEAD_BYTES, NAME_BYTES, SKIPPED_FOLDERS, TYPES

#: Bytes of listed files that one task reads, about, and what a file counts besides its own.
PART_BYTES, FILE_BYTES = 32 << 20, 64 << 10


def wanted(name: str, extensions: frozenset[str]) -> bool:
    stem, dot, ext = name.rpartition(".")
    return bool(dot and stem) and ext.lower() in extensions and not name.startswith((".", "~$"))


def walk(root: str, extensions: frozenset[str], skipped: frozenset[str], excluded: frozenset[str]) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime) of the files that are kept, level by level; names in `excluded` are left out at the root alone.

    Links are not followed; what vanishes or can't be read while listing is left out, as are empty files.
    """
    level, top = [root], True
    while level:
        below = []
        for folder in level:
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        if not e.name.startswith(".") and e.name not in skipped and not (top and e.name in excluded):
                            below.append(e.path)
                    elif e.is_file(follow_symlinks=False) and wanted(e.name, extensions) and (st := e.stat(follow_symlinks=False)).st_size:
                        yield e.path, st.st_size, int(st.st_mtime)
                except OSError:
                    continue
        level, top = below, False


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        # option names come in lower case
        names = lambda key, default: frozenset(x for x in options.get(key, ",".join(default)).split(",") if x)
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.extensions, self.skipped, self.excluded = names("extensions", EXTENSIONS), names("skipped", SKIPPED_FOLDERS), names("excluded", [])
        self.contents = options.get("contents", "true").lower() == "true"
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Part]:
        parts, held, size = [], [], 0
        for f in walk(self.root, self.extensions, self.skipped, self.excluded):
            held.append(f)
            size += FILE_BYTES + (f[1] if self.contents and f[1] <= NAME_BYTES else 0)
            if size >= self.part_bytes:
                parts.append(Part(held))
                held, size = [], 0
        return [*parts, Part(held)] if held or not parts else parts

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, size, mtime in partition.files:
            ext = path.rpartition(".")[2].lower()
            mode = "filename_only" if size > NAME_BYTES else "head_only" if size > HEAD_BYTES else "full"
            content, error = None, None
            if self.contents and mode != "filename_only":
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
            yield path, size, mtime, hashlib.sha1(path.encode("utf-8", "surrogateescape")).hexdigest(), TYPES.get(ext, ext), mode, content, error


class FolderTree(DataSource):
    """path, size, mtime, doc_id (SHA-1 of the path), doc_type, mode, content and error of the files below a folder.

    Options: path; extensions, skipped (folders left out everywhere) and excluded (folders left out below the root), as
    comma-separated names; contents=false leaves files unopened; partBytes.  Content is null for files of which only the
    name counts, and for those that can't be opened, with the error.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return "path string, size long, mtime long, doc_id string, doc_type string, mode string, content binary, error string"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read_tree(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The rows of a FolderTree, which is registered first."""
    spark.dataSource.register(FolderTree)
    reader = spark.read.format("folder_tree").option("path", root)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def subfolders(spark: SparkSession, root: str) -> DataFrame:
    """path and name of the folders right below a root that are not hidden, by name; none for a root that isn't there."""
    try:
        names = sorted(e.name for e in os.scandir(root) if e.is_dir() and not e.name.startswith("."))
    except OSError:
        names = []
    return spark.createDataFrame([(os.path.join(root, n), n) for n in names], "path string, name string")
