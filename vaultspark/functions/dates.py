"""Column functions over dates: validation, ISO times, note patterns, the frontmatter's dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim


def valid_date(c: Column | str) -> Column:
    """Whether a string is YYYY-MM-DD and a day of the calendar."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def iso_seconds(c: Column | str, zone_required: bool = False) -> Column:
    """Epoch seconds of an ISO time (Z, an offset, or none: UTC, unless a zone is required); null if it is none."""
    c = F.col(c) if isinstance(c, str) else c
    zoned = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)(Z|[+-]\d{2}:\d{2})?", 1)
    zone = F.regexp_extract(c, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(Z|[+-]\d{2}:\d{2})?", 1)
    whole = F.substring(zoned, 1, 19)
    hours = F.coalesce(F.try_to_number(F.substring(zone, 2, 2), F.lit("99")), F.lit(0)).cast("long")
    minutes = F.coalesce(F.try_to_number(F.substring(zone, 5, 2), F.lit("99")), F.lit(0)).cast("long")
    offset = F.when(zone.isin("", "Z"), F.lit(0)).otherwise(F.when(zone.startswith("-"), -1).otherwise(1) * (hours * 3600 + minutes * 60))
    local = F.unix_seconds(F.try_to_timestamp(F.concat(whole, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    found = F.when(zoned != "", local - offset)
    return F.when(zone != "", found) if zone_required else found


def date_seconds(c: Column | str) -> Column:
    """Epoch seconds of a bare date (midnight UTC) or of an ISO time with a zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(valid_date(c), F.unix_date(F.try_to_date(c, "yyyy-MM-dd")).cast("long") * 86400).otherwise(iso_seconds(c, zone_required=True))


def frontmatter(content: Column | str, closed: bool = False) -> Column:
    """The lines between a first `---` and the next; null without. `closed`: null too if nothing closes it."""
    c = F.col(content) if isinstance(content, str) else content
    open_ = c.rlike(r"(?Ud)\A[^\S\n]*---[^\S\n]*(?:\n|\z)")
    inner = F.regexp_extract(c, r"(?Ud)\A[^\S\n]*---[^\S\n]*\n((?s:.*?))(?:(?<=\n)[^\S\n]*---[^\S\n]*(?:\n|\z)|\z)", 1)
    found = F.when(open_, inner)
    has_end = c.rlike(r"(?Ud)\A[^\S\n]*---[^\S\n]*\n(?:[^\n]*\n)*?[^\S\n]*---[^\S\n]*(?:\n|\z)")
    return F.when(has_end, found) if closed else found


def _unquote(c: Column) -> Column:
    """Without outer double, then outer single quotes."""
    return F.regexp_replace(F.regexp_replace(trim(c), '^"+|"+$', ""), "^'+|'+$", "")


def updated_field(content: Column | str) -> Column:
    """The first non-empty unindented `updated:` value of the frontmatter, quotes trimmed, as it is written."""
    values = F.transform(F.regexp_extract_all(frontmatter(content), F.lit(r"(?md)^updated:(.*)$"), F.lit(1)), _unquote)
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


def frontmatter_date(content: Column | str) -> Column:
    """Epoch seconds: of `updated`, else `created`, else `date`; of each the first line that can be read."""
    def of(key: str) -> Column:
        values = F.transform(F.regexp_extract_all(frontmatter(content), F.lit(rf"(?md)^\s*{key}:(.*)$"), F.lit(1)), _unquote)
        return F.get(F.filter(F.transform(values, date_seconds), lambda v: v.isNotNull()), F.lit(0))

    return F.coalesce(*map(of, ("updated", "created", "date")))


def note_path(pattern: Column | str, date: Column | str) -> Column:
    """The path of a day's note: YYYY, MM and DD of the pattern replaced wherever they stand."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    for mark, form in (("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd")):
        p = F.replace(p, F.lit(mark), F.date_format(date, form))
    return p
