"""File scan as a Python data source: directories are walked on the executors, some levels below the roots in parallel.

Spark's own file sources hide names that begin with `_` or `.`; a catalogue must not.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import matches_any
from ..functions.text import CONTENT_TYPES
from ..schema import SCAN
from ..shipping import ship_package
from . import pdf

FOUND = "path string, mtime_ns bigint, size bigint, content_type string"
# What macOS keeps beside a user's files.
MAC_DIRS, MAC_FILES, MAC_PREFIX = {".Trash", ".Spotlight-V100", ".fseventsd"}, {".DS_Store"}, "._"


def type_of(path: str) -> str | None:
    return CONTENT_TYPES.get(os.path.splitext("x" + os.path.basename(path))[1].lower())


def walk(root: str, skip_macos: bool = False) -> Iterator[tuple[str, int, int, str]]:
    """(path, mtime in ns, size, content type) of supported files, a folder's own in name order before those below.
    Unreadable entries are passed over and links are not followed."""
    try:
        info = os.lstat(root)
    except OSError:
        return
    if not stat.S_ISDIR(info.st_mode):
        kind = type_of(root)
        if kind and not (skip_macos and (os.path.basename(root) in MAC_FILES or os.path.basename(root).startswith(MAC_PREFIX))):
            yield root, info.st_mtime_ns, info.st_size, kind
        return
    waiting = [root]
    while waiting:
        top = waiting.pop()
        folders = []
        for full, is_folder in entries(top, skip_macos):
            if is_folder:
                folders.append(full)
            else:
                yield from walk(full, skip_macos)
        waiting += reversed(folders)


def entries(folder: str, skip_macos: bool) -> list[tuple[str, bool]]:
    """(path, is a folder) of a folder's entries by name; none of an unreadable one."""
    try:
        with os.scandir(folder) as found:
            return sorted((e.path, e.is_dir(follow_symlinks=False)) for e in found if not (skip_macos and e.name in MAC_DIRS))
    except OSError:
        return []


class _Part(InputPartition):
    """Folders and files to walk, each whole."""

    def __init__(self, tops: list[str]):
        self.tops = tops


#: Parts that a scan is cut into where the folders allow it; files of one folder go together in parts of FILES.
PARTS, FILES = 512, 1000


def parts(roots: list[str], skip_macos: bool) -> list[list[str]]:
    """The roots, or their folders, or theirs: level by level until there are PARTS of them."""
    done: list[list[str]] = []
    level = list(roots)
    while level and len(done) + len(level) < PARTS:
        below: list[str] = []
        for top in level:
            if not os.path.isdir(top) or os.path.islink(top):
                done.append([top])
                continue
            found = entries(top, skip_macos)
            below += [p for p, is_folder in found if is_folder]
            files = [p for p, is_folder in found if not is_folder]
            done += [files[k : k + FILES] for k in range(0, len(files), FILES)]
        level = below
    return done + [[top] for top in level]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r for r in options.get("roots", "").split("\n") if r]
        self.skip = options.get("skip_macos_metadata", "false").lower() == "true"

    def partitions(self):
        return [_Part(p) for p in parts(self.roots, self.skip)] or [_Part([])]

    def read(self, partition):
        for top in partition.tops:
            yield from walk(top, self.skip)


class FileScan(DataSource):
    """format("leafquarry_files") with options roots (one a line) and skip_macos_metadata."""

    @classmethod
    def name(cls):
        return "leafquarry_files"

    def schema(self):
        return FOUND

    def reader(self, schema):
        return _Reader(self.options)


def scan(spark: SparkSession, paths: list[str], skip_macos: bool = False) -> DataFrame:
    """Every supported file below the paths; a file below two of them comes twice."""
    ship_package(spark)
    spark.dataSource.register(FileScan)
    return spark.read.format("leafquarry_files").option("roots", "\n".join(paths)).option("skip_macos_metadata", str(skip_macos).lower()).load()


def sha256_file(path: str, block: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def pages_of(path: str, content_type: str) -> int:
    return pdf.page_count(path) if content_type == "pdf" else 1


def measured(files: DataFrame, page_count: Callable[[str, str], int] = pages_of, excludes: list[str] | None = None, workers: int | None = None) -> DataFrame:
    """Scan rows with checksum and page_count, or error; excluded files go before they are read. Files are dealt to
    `workers` tasks; without, to four for each core of the cluster, since they differ in size."""
    ship_package(files.sparkSession)
    kept = files.where(~matches_any(F.col("path"), excludes or []))

    def measure(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for r in b.itertuples():
                checksum = pages = error = None
                try:
                    checksum = sha256_file(r.path)
                    pages = 1 if r.content_type != "pdf" else int(page_count(r.path, r.content_type))
                except Exception as e:  # noqa: BLE001  the file's failure is its result
                    checksum, error = None, str(e)[:200]
                rows.append((r.path, r.mtime_ns, r.size, r.content_type, checksum, pages, error))
            out = pd.DataFrame(rows, columns=SCAN.names)
            out["page_count"] = out["page_count"].astype("Int32")
            yield out

    return kept.repartition(workers or 4 * files.sparkSession.sparkContext.defaultParallelism).mapInPandas(measure, SCAN)
