"""Vaults: folders of Markdown files as DataFrames.

Spark's own file index leaves out names that begin with `_` or `.`, which notes may have; so the
driver lists paths (names only) and the executors read the files. Where a vault lies in a store that
only Spark reads, `from_files` reads it through Spark, without those names.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load
from ..workers import ship

NOTES = "path string, file_name string, content string, size long, mtime timestamp"
_ARROW = pa.schema([("path", pa.string()), ("file_name", pa.string()), ("content", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))])


def excluded(path: str, config: Config) -> bool:
    """A pattern that the whole path matches (`*` crosses folders), or that is part of it."""
    return any(p in path or fnmatch.fnmatchcase(path, p.replace("**/", "*").replace("**", "*")) or fnmatch.fnmatchcase(path, p) for p in config.exclude_paths)


def walk(base: str, config: Config, markdown: bool = True, folders: bool = False) -> Iterator[str]:
    """Paths below `base` in order, excluded files and folders pruned; only `.md` files if `markdown`; folders too if asked.

    A `base` that is a file stands for itself, and is not held against the exclusions.
    """
    if os.path.isfile(base) and (not markdown or base.endswith(".md")):
        yield base
    if not os.path.isdir(base):
        return
    for entry in sorted(os.scandir(base), key=lambda e: e.name):
        if excluded(entry.path, config):
            continue
        if entry.is_dir():
            if folders:
                yield entry.path
            yield from walk(entry.path, config, markdown, folders)
        elif not markdown or entry.name.endswith(".md"):
            yield entry.path


class Vault:
    """A folder and its configuration; every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, path: str | os.PathLike, config: Config | None = None):
        self.spark, self.path = spark, os.path.realpath(path)
        self.config = config or load(self.path)

    def paths(self, subpath: str = "", markdown: bool = True) -> list[str]:
        return list(walk(self.inside(subpath), self.config, markdown))

    def inside(self, subpath: str) -> str:
        """The real path of a relative one; a ValueError if it leaves the vault."""
        real = os.path.realpath(os.path.join(self.path, subpath))
        if real != self.path and not real.startswith(self.path + os.sep):
            raise ValueError(f"outside the vault: {subpath}")
        return real

    def existing(self, subpath: str) -> str:
        """As `inside`; a ValueError too if nothing is there."""
        real = self.inside(subpath)
        if not os.path.exists(real):
            raise ValueError(f"Path does not exist: {subpath}")
        return real

    def note_path(self, file_path: str) -> str:
        """The real path of one note; a ValueError if it is missing, outside the vault or no `.md` file."""
        real = self.inside(file_path)
        if not os.path.exists(real):
            raise ValueError(f"File not found: {file_path}")
        if not real.endswith(".md"):
            raise ValueError(f"Invalid file type '{file_path}': only .md files allowed")
        return real

    def listed(self, file_path: str) -> bool:
        """Whether `notes` has the file: an `.md` file that no exclusion covers, itself or a folder above."""
        real = self.inside(file_path)
        steps = os.path.relpath(real, self.path).split(os.sep)
        above = [os.path.join(self.path, *steps[: i + 1]) for i in range(len(steps))]
        return os.path.isfile(real) and real.endswith(".md") and not any(excluded(p, self.config) for p in above)

    def files(self, subpath: str = "") -> DataFrame:
        """(path, size, is_dir) of every file, of any kind, and every folder (its size is null)."""
        base = self.inside(subpath)
        every = [(p, os.path.isdir(p)) for p in walk(base, self.config, markdown=False, folders=True)]
        rows = [(os.path.relpath(p, base), None if d else os.path.getsize(p), d) for p, d in every if p != base]
        return self.spark.createDataFrame(rows, "path string, size long, is_dir boolean")

    def notes(self, subpath: str = "") -> DataFrame:
        """NOTES of the vault, or of the one file that `subpath` names; files that cannot be read or are no UTF-8 are left out."""
        return self.read(self.paths(subpath))

    def read(self, found: list[str]) -> DataFrame:
        """NOTES of the files of these real paths: nothing else is read."""
        ship(self.spark)
        base = self.path
        listed = self.spark.createDataFrame([(p,) for p in found], "p string").repartition(max(1, min(len(found), self.spark.sparkContext.defaultParallelism * 4)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for p in batch.column(0).to_pylist():
                    try:
                        with open(p, "rb") as f:
                            raw = f.read()
                        mtime = datetime.fromtimestamp(os.stat(p).st_mtime, UTC)
                        rows.append({"path": os.path.relpath(p, base), "file_name": os.path.basename(p), "content": raw.decode("utf-8"), "size": len(raw), "mtime": mtime})
                    except (OSError, UnicodeDecodeError):
                        continue
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

        return listed.mapInArrow(run, NOTES)


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """NOTES of all `.md` files below a path that Spark reads; names beginning with `_` or `.` are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", name.alias("file_name"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def from_documents(docs: DataFrame, content: str = "text") -> DataFrame:
    """NOTES of a documents table: the id is the path."""
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(path.alias("path"), path.alias("file_name"), F.col(content).alias("content"), F.octet_length(content).cast("long").alias("size"), F.timestamp_seconds(F.lit(0)).alias("mtime"))
