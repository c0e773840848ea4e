"""Daily notes: a calendar joined with the patterns' paths."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DAILY_PATTERNS
from ..functions.dates import note_path

MOST_DAYS = 365


def _day(s: str) -> datetime.date:
    if len(s) != 10:
        raise ValueError(f"not a date: {s}")
    return datetime.date.fromisoformat(s)


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(day): every day from start to end."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))


def bounds(start: str | None, end: str | None, today: datetime.date | None = None) -> tuple[str, str]:
    """The range asked for; without a start the thirty days up to its end, without an end up to today."""
    last = _day(end) if end else today or datetime.datetime.now(datetime.UTC).date()
    first = _day(start) if start else last - datetime.timedelta(days=29)
    if first > last:
        raise ValueError("start_date is after end_date")
    if (last - first).days + 1 > MOST_DAYS:
        raise ValueError(f"a range is limited to {MOST_DAYS} days")
    return first.isoformat(), last.isoformat()


def expected(days: DataFrame, patterns: tuple[str, ...] = DAILY_PATTERNS) -> DataFrame:
    """(day, path) for each day and pattern: few rows, made without a join."""
    paths = F.array(*[note_path(p, F.col("day")) for p in patterns])
    return days.select("day", F.explode(F.array_distinct(paths)).alias("path"))


def find(notes: DataFrame, days: DataFrame, patterns: tuple[str, ...] = DAILY_PATTERNS) -> DataFrame:
    """(day, path, file_name, content) of days that have exactly one note; several are ambiguous and none is taken."""
    hits = notes.join(F.broadcast(expected(days, patterns)), "path")  # a year of days at most
    one = hits.groupBy("day").agg(F.count("*").alias("n"), F.first("path").alias("path"), F.first("file_name").alias("file_name"), F.first("content").alias("content"))
    return one.where("n = 1").drop("n")


def search(notes: DataFrame, start: str | None = None, end: str | None = None, sort: str = "desc", limit: int | None = 100, include_content: bool = False, patterns: tuple[str, ...] = DAILY_PATTERNS, today: datetime.date | None = None) -> DataFrame:
    """(date, file_path, file_name[, content]); newest first unless `sort` is asc."""
    first, last = bounds(start, end, today)
    found = find(notes, calendar(notes.sparkSession, first, last), patterns)
    found = found.orderBy(F.asc("day") if sort == "asc" else F.desc("day"))
    found = found if limit is None else found.limit(limit)
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("date"), F.col("path").alias("file_path"), "file_name", *["content"] * include_content)


def get(notes: DataFrame, date: str, patterns: tuple[str, ...] = DAILY_PATTERNS) -> DataFrame:
    """One row (found, date, file_path, content)."""
    day = _day(date).isoformat()
    days = calendar(notes.sparkSession, day, day)
    return days.join(find(notes, days, patterns), "day", "left").select(F.col("path").isNotNull().alias("found"), F.lit(day).alias("date"), F.col("path").alias("file_path"), "content")
