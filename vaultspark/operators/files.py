"""File listings, reads and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_seconds, updated_field
from ..functions.text import format_size

ROOT = ""


def tree_rows(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(path, parent, name, depth, is_dir, size_bytes) of every file of files(path, size[, is_dir]) and every folder above.

    With `is_dir` the rows may be folders too, which need hold nothing. Names that begin with a dot
    are skipped with all below them. Folders have the size of nothing (null). `max_depth` keeps the
    first levels.
    """
    folder = F.col("is_dir") if "is_dir" in files.columns else F.lit(False)
    shown = files.where(~F.exists(F.split("path", "/"), lambda x: x.startswith(".")))
    parts = F.split("path", "/")
    steps = shown.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("depth"), ((i < F.size(parts)) | folder).alias("is_dir"), F.when((i == F.size(parts)) & ~folder, F.col("size")).alias("size_bytes")))).alias("e")).select("e.*")
    found = steps.groupBy("path", "depth").agg(F.max("is_dir").alias("is_dir"), F.max("size_bytes").alias("size_bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.array_join(F.slice(F.split("path", "/"), 1, F.col("depth") - 1), "/")
    found = found.select("path", parent.alias("parent"), name.alias("name"), "depth", "is_dir", "size_bytes")
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


def sort_key(is_dir_of: Column, path: Column) -> Column:
    """Orders a tree: in each folder folders first, then by name."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    return F.array_join(F.transform(parts, lambda x, i: F.concat(F.when((i < last) | is_dir_of, "0").otherwise("1"), x)), "\u0001")


def tree_totals(rows: DataFrame, max_depth: int | None = None) -> DataFrame:
    """One row (total_files, total_dirs); the root is a folder. Folders at the last level shown are not counted."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    opened = F.col("is_dir") if max_depth is None else F.col("is_dir") & (F.col("depth") < max_depth)
    return rows.agg(count(~F.col("is_dir")).alias("total_files"), (count(opened) + (0 if max_depth == 0 else 1)).alias("total_dirs"))


def render(rows: DataFrame, root: str, include_sizes: bool = False) -> str:
    """The tree as text, two spaces a level, folders with a slash. A listing is for reading: it comes to the driver."""
    line = F.concat(F.expr("repeat('  ', depth)"), "name", F.when(F.col("is_dir"), "/").otherwise(F.concat(F.lit(" ("), format_size(F.col("size_bytes")), F.lit(")")) if include_sizes else F.lit("")))
    ordered = rows.orderBy(sort_key(F.col("is_dir"), F.col("path"))).select(line.alias("line"))
    return "\n".join([f"{root}/", *(r["line"] for r in ordered.toLocalIterator())])


def read(notes: DataFrame, paths: list[str]) -> DataFrame:
    """(file_path, file_name, success, content, error) for each asked path, in the order asked."""
    spark = notes.sparkSession
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, file_path string")
    found = asked.join(notes.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
    return found.select("i", "file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.col("content").isNotNull().alias("success"), "content", F.when(F.col("content").isNull(), F.concat(F.lit("File not found: "), "file_path")).alias("error")).orderBy("i").drop("i")


def timestamps(notes: DataFrame) -> DataFrame:
    """`notes` with ts (epoch seconds), date_source and updated_at: the frontmatter's `updated`, else the file's time."""
    own = updated_field("content")
    known = iso_seconds(own)
    mtime = F.unix_seconds("mtime")
    utc = F.date_format(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(mtime))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return notes.withColumns({"ts": F.coalesce(known, mtime), "date_source": F.when(known.isNotNull(), "frontmatter").otherwise("mtime"), "updated_at": F.when(known.isNotNull(), own).otherwise(utc)})


def recent(notes: DataFrame, limit: int | None = 20, since: str | None = None) -> DataFrame:
    """(file_path, file_name, updated_at, date_source), newest first; `since` is a day, from midnight UTC."""
    found = timestamps(notes)
    if since is not None:
        found = found.where(F.col("ts") >= F.unix_date(F.to_date(F.lit(since))).cast("long") * 86400)
    found = found.orderBy(F.desc("ts"), "path").select(F.col("path").alias("file_path"), "file_name", "updated_at", "date_source")
    return found if limit is None else found.limit(limit)
