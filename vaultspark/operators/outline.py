"""Headings, sections and outlines. A note's lines and headings stay arrays, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chomp, let, raw_lines, trim

# Fixed value: what a heading line looks like, with an optional id that is no part of the title.
HEADING = r"(?Ud)^(#{1,6})\s+(.+?)(?:\s*\{#[^}]*\})?\s*$"
_NEVER = 2147483647


def _candidates(raw: Column) -> Column:
    """(n, line) of the lines that can be headings or fences, so that no pattern is tried on the others."""
    numbered = F.transform(raw, lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    return F.filter(numbered, lambda x: F.startswith(x["line"], F.lit("#")) | F.contains(x["line"], F.lit("```")) | F.contains(x["line"], F.lit("~~~")))


def fences(numbered: Column) -> Column:
    """(first, last) lines of fenced code; a fence closes with its own kind, or not at all."""
    kind = lambda x: F.regexp_extract(x["line"], r"(?U)^\s*(```|~~~)", 1)
    marks = F.transform(F.filter(numbered, lambda x: kind(x) != ""), lambda x: F.struct(x["n"].alias("n"), kind(x).alias("kind")))
    span = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        return (
            F.when(state["open"] == "", F.struct(x["kind"].alias("open"), x["n"].alias("at"), state["spans"].alias("spans")))
            .when(state["open"] == x["kind"], F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.concat(state["spans"], F.array(span(state["at"], x["n"]))).alias("spans")))
            .otherwise(state)
        )

    return F.aggregate(marks, start, step, lambda s: F.when(s["open"] == "", s["spans"]).otherwise(F.concat(s["spans"], F.array(span(s["at"], F.lit(_NEVER))))))


def _headings(raw: Column) -> Column:
    """(level, title, line_number) of each heading line outside fences. Lines and fences are made once for a note, not for each line."""
    outside = lambda x, spans: ~F.exists(spans, lambda f: x["line_number"].between(f["first"], f["last"]))

    def of(lines: Column) -> Column:
        own = F.transform(F.filter(lines, lambda x: F.startswith(x["line"], F.lit("#"))), lambda x: F.struct(F.regexp_extract(x["line"], "^#+", 0).alias("marks"), F.regexp_extract(chomp(x["line"]), HEADING, 2).alias("title"), x["n"].alias("line_number")))
        found = lambda spans: F.filter(own, lambda x: (x["title"] != "") & outside(x, spans))
        return let(fences(lines), lambda spans: F.transform(found(spans), lambda x: F.struct(F.length(x["marks"]).alias("level"), x["title"].alias("title"), x["line_number"].alias("line_number"))))

    return let(_candidates(raw), of)


def with_headings(notes: DataFrame, content: str = "content") -> DataFrame:
    """`notes` with `raw` (lines as they are) and `hs` (level, title, line_number of each heading)."""
    return notes.withColumn("raw", F.coalesce(raw_lines(content), F.array().cast("array<string>"))).withColumn("hs", _headings(F.col("raw")))


def _close(hs: Column, h: Column, i: Column) -> Column:
    """The last line of the section of heading h, which is i-th of hs; null if it is the note's."""
    return F.get(F.filter(F.slice(hs, i + 2, F.size(hs)), lambda p: p["level"] <= h["level"]), F.lit(0))["line_number"] - 1


def _placed(hs: Column) -> Column:
    """Each heading with its parent's line, its section's last line, and the last line before any heading."""

    def one(hs: Column, h: Column, i: Column) -> Column:
        parent = let(F.filter(F.slice(hs, 1, i), lambda p: p["level"] < h["level"]), lambda above: F.get(above, F.size(above) - 1)["line_number"])
        return F.struct(i.alias("seq"), h["level"].alias("level"), h["title"].alias("title"), h["line_number"].alias("line_number"), parent.alias("parent_line"), _close(hs, h, i).alias("close"), (F.get(hs, i + 1)["line_number"] - 1).alias("next"))

    return let(hs, lambda all_: F.transform(all_, lambda h, i: one(all_, h, i)))


def headings(notes: DataFrame) -> DataFrame:
    """(path, seq, level, title, line_number, parent_line); parent: the nearest heading above of a smaller level."""
    return with_headings(notes).select("path", F.explode(_placed(F.col("hs"))).alias("h")).select("path", "h.seq", "h.level", "h.title", "h.line_number", "h.parent_line")


def _section(raw: Column, first: Column, last: Column) -> Column:
    return trim(F.array_join(F.slice(raw, first, F.greatest(last - first + 1, F.lit(0))), ""))


def _placed_or_whole(hs: Column) -> Column:
    """`_placed`, or the one section of level 0 of a note without headings."""
    none = F.struct(F.lit(0).alias("seq"), F.lit(0).alias("level"), F.lit("").alias("title"), F.lit(1).alias("line_number"), *[F.lit(None).cast("int").alias(x) for x in ("parent_line", "close", "next")])
    return F.when(F.size(hs) == 0, F.array(none)).otherwise(_placed(hs))


def _of(h: Column, raw: Column, include_subsections: bool) -> list[Column]:
    """seq, level, title, content, start_line and end_line of the section of a placed heading."""
    last, whole = F.size(raw), h["level"] == 0
    end = F.when(whole, F.greatest(last, F.lit(1))).otherwise(F.coalesce(h["close"] if include_subsections else h["next"], last))
    first = F.when(whole, F.lit(1)).otherwise(h["line_number"] + 1)
    return [h["seq"].alias("seq"), h["level"].alias("level"), h["title"].alias("title"), _section(raw, first, end).alias("content"), h["line_number"].alias("start_line"), end.alias("end_line")]


def with_sections(notes: DataFrame, out: str, include_subsections: bool = True) -> DataFrame:
    """`notes` with `out`, the sections (seq, level, title, content, start_line, end_line) of each; one of level 0 without headings."""
    found = with_headings(notes)
    return found.withColumn(out, F.transform(_placed_or_whole(F.col("hs")), lambda h: F.struct(*_of(h, F.col("raw"), include_subsections)))).drop("raw", "hs")


def sections(notes: DataFrame, include_subsections: bool = True) -> DataFrame:
    """(path, seq, level, title, content, start_line, end_line); one of level 0 for a note without headings."""
    # The headings are exploded, not the sections: a filter on those would be pushed below all that makes them, and make it again.
    rows = with_headings(notes).select("path", "raw", F.explode(_placed_or_whole(F.col("hs"))).alias("h"))
    return rows.select("path", *_of(F.col("h"), F.col("raw"), include_subsections))


def section(notes: DataFrame, title: str, include_subsections: bool = True) -> DataFrame:
    """Sections whose title is `title`, case ignored."""
    return sections(notes, include_subsections).where((F.lower("title") == title.lower()) & (F.col("level") > 0))


def search(notes: DataFrame, pattern: str, min_level: int = 1, max_level: int = 6, limit: int | None = None) -> DataFrame:
    """Headings whose title holds `pattern`, case ignored, within the levels."""
    if not 1 <= min_level <= max_level <= 6:
        raise ValueError("levels are 1 to 6")
    found = headings(notes).where(F.contains(F.lower("title"), F.lit(pattern.lower())) & F.col("level").between(min_level, max_level))
    found = found.select("path", "level", "title", "line_number").orderBy("path", "line_number")
    return found if limit is None else found.limit(limit)


def without_sections(notes: DataFrame, exclude: list[str], content: str = "content") -> DataFrame:
    """`notes` whose `content` lacks the sections of excluded headings; all other lines as they were."""
    if not exclude:
        return notes
    found = with_headings(notes, content)
    bad = lambda title: F.exists(F.array(*[F.lit(p.lower()) for p in exclude]), lambda p: F.contains(title, p))
    placed = lambda hs: F.filter(F.transform(hs, lambda h, i: F.struct(h["level"].alias("level"), h["line_number"].alias("first"), F.lower(h["title"]).alias("title"), i.alias("i"))), lambda h: bad(h["title"]))
    spans = let(F.col("hs"), lambda hs: F.transform(placed(hs), lambda h: F.struct(h["first"].alias("first"), F.coalesce(_close(hs, h, h["i"]), F.lit(_NEVER)).alias("last"))))
    # The spans are made once for a note, not for each line.
    kept = let(spans, lambda all_: F.filter("raw", lambda x, i: ~F.exists(all_, lambda s: (i + 1).between(s["first"], s["last"]))))
    return found.withColumn(content, F.when(F.col(content).isNotNull(), F.array_join(kept, ""))).select(notes.columns)


def tree(rows: list[dict]) -> list[dict]:
    """Nested outline of one note's headings (level, title, line_number in order)."""
    roots: list[dict] = []
    path: list[dict] = []
    for r in rows:
        node = {"title": r["title"], "level": r["level"], "line_number": r["line_number"], "children": []}
        while path and path[-1]["level"] >= node["level"]:
            path.pop()
        (path[-1]["children"] if path else roots).append(node)
        path.append(node)
    return roots
