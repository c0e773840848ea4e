"""Tasks: checkbox lines, their metadata and sub-items, and filters over them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, trim
from ..workers import ship

# What task lines look like, and the marks of their metadata.
LINE = r"(?Ud)^\s*-\s*\[(.)\]\s*(.+)$"
DUE = [r"(?U)📅\s*(\d{4}-\d{2}-\d{2})", r"(?U)due:\s*(\d{4}-\d{2}-\d{2})", r"(?U)@due\((\d{4}-\d{2}-\d{2})\)"]
CREATED = [r"(?U)➕\s*(\d{4}-\d{2}-\d{2})", r"(?U)created:\s*(\d{4}-\d{2}-\d{2})"]
COMPLETED = [r"(?U)✅\s*(\d{4}-\d{2}-\d{2})", r"(?U)completed:\s*(\d{4}-\d{2}-\d{2})"]
PRIORITY_MARK = "[⏫🔼🔽⏬]"
PRIORITY_TEXT = r"priority:\s*(?:high|medium|low)"
PRIORITY = {"⏫": "urgent", "🔼": "high", "🔽": "low", "⏬": "lowest"}
TIME = r"(?U)^\d{2}:\d{2} "


def mark(line: Column | str) -> Column:
    """The sign in the checkbox, or an empty string if the line is no task."""
    return F.regexp_extract(line, LINE, 1)


def status(line: Column | str) -> Column:
    return status_of(mark(line))


def status_of(sign: Column) -> Column:
    known = F.when(sign.rlike(r"(?U)^\s$"), "incomplete").when(F.lower(sign) == "x", "completed").when(sign == "-", "cancelled")
    return F.when(sign != "", known.otherwise(F.concat(F.lit("other_"), sign)))


def content(line: Column | str) -> Column:
    return F.regexp_extract(line, LINE, 2)


def _first(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def tags(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)#(\w+)"), F.lit(1))


def due_date(text: Column) -> Column:
    return _first(text, DUE)


def created_date(text: Column) -> Column:
    return _first(text, CREATED)


def completed_date(text: Column) -> Column:
    return _first(text, COMPLETED)


def priority(text: Column) -> Column:
    found = F.regexp_extract(text, f"(?U){PRIORITY_MARK}|{PRIORITY_TEXT}", 0)
    named = F.nullif(F.regexp_extract(found, r"(high|medium|low)$", 1), F.lit(""))
    out = F.when(found == "", F.lit(None).cast("string"))
    for sign, name in PRIORITY.items():
        out = out.when(found == sign, name)
    return out.otherwise(named)


def clean(text: Column) -> Column:
    """The content without dates, time, priority and doubled white space; tags stay."""
    for p in DUE:
        text = F.regexp_replace(text, p, "")
    text = F.regexp_replace(text, TIME, " ")
    text = F.regexp_replace(F.regexp_replace(text, PRIORITY_MARK, ""), f"(?iU){PRIORITY_TEXT}", "")
    for p in (*CREATED, *COMPLETED):
        text = F.regexp_replace(text, p, "")
    return trim(F.regexp_replace(text, r"(?U)\s+", " "))


def parsed(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """`df`'s rows whose `line` is a task, with content, status, tags, dates and priority."""
    text = content(line)
    marked = df.withColumn("_sign", mark(line)).where("_sign <> ''").withColumns({"status": status_of(F.col("_sign")), "_text": text}).drop("_sign")
    return marked.withColumns({
        "content": clean(F.col("_text")), "tags": tags("_text"), "due_date": due_date(F.col("_text")), "priority": priority(F.col("_text")),
        "created_date": created_date(F.col("_text")), "completed_date": completed_date(F.col("_text")),
    }).drop("_text")


_TASK = re.compile(r"^\s*-\s*\[.\]\s*.+$")
_BOX = re.compile(r"^-\s*\[.\]\s*(.+)$")


def attach(rows: list[str]) -> list[tuple[int, str, list[str]]]:
    """(line number, line, sub-items) of each task; list lines below and deeper than it are its own."""
    out: list[tuple[int, str, list[str]]] = []
    depth = -1  # bytes of the open task's indentation
    for n, row in enumerate(rows, start=1):
        text = row.strip()
        indent = len(row.encode()) - len(row.lstrip().encode())
        if depth >= 0 and text[:1] in ("-", "*") and text and indent > depth:
            box = _BOX.match(text) if text.startswith("- [") else None
            out[-1][2].append((box[1] if box else text[1:]).strip())
        elif _TASK.match(row):
            out.append((n, row, []))
            depth = indent
        else:
            depth = -1
    return out


_ATTACHED = "array<struct<line_number:int,raw_line:string,sub_items:array<string>>>"


def _attached(notes: pd.Series) -> pd.Series:
    return notes.map(lambda rows: [{"line_number": n, "raw_line": r, "sub_items": s} for n, r, s in attach(list(rows))])


def extract(notes: DataFrame) -> DataFrame:
    """Tasks of `notes(path, file_name, content)`. The order of a note's lines decides, so a note stays whole."""
    ship(notes.sparkSession)
    found = notes.select("path", "file_name", F.explode(F.pandas_udf(_attached, _ATTACHED)(lines("content"))).alias("t"))
    rows = found.select(F.col("path").alias("file_path"), "file_name", "t.*")
    return parsed(rows).withColumn("summary", F.lit(None).cast("string")).select("content", "status", "file_path", "file_name", "line_number", "raw_line", "tags", "sub_items", "summary", "due_date", "priority", "created_date", "completed_date")


def filtered(tasks: DataFrame, status: str | None = None, due_on: str | None = None, due_before: str | None = None, due_after: str | None = None, completed_on: str | None = None, completed_before: str | None = None, completed_after: str | None = None, tags: list[str] | None = None, exclude_tags: list[str] | None = None) -> DataFrame:
    """Tasks that pass all the given filters; a missing date fails every filter on it."""
    for name, value, test in (
        ("status", status, "eq"), ("due_date", due_on, "eq"), ("due_date", due_before, "lt"), ("due_date", due_after, "gt"),
        ("completed_date", completed_on, "eq"), ("completed_date", completed_before, "lt"), ("completed_date", completed_after, "gt"),
    ):
        if value is not None:
            c = F.col(name)
            tasks = tasks.where(c == value if test == "eq" else c < value if test == "lt" else c > value)
    for tag in tags or []:
        tasks = tasks.where(F.array_contains("tags", tag))
    if exclude_tags:
        tasks = tasks.where(~F.arrays_overlap("tags", F.array(*map(F.lit, exclude_tags))))
    return tasks


def search(notes: DataFrame, limit: int | None = 50, **filters) -> DataFrame:
    """The first `limit` tasks by path and line that pass the filters."""
    found = filtered(extract(notes), **filters).orderBy("file_path", "line_number")
    return found if limit is None else found.limit(limit)
