"""Tags of the frontmatter: extraction, counts, search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import frontmatter
from ..functions.text import trim
from ..workers import ship


def parse_yaml(block: str | None) -> list[str] | None:
    """Tags of a YAML block: the strings of a sequence, or a scalar string. None if it is no YAML."""
    import yaml

    if block is None:
        return []
    try:
        found = yaml.load(block, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return None
    tags = found.get("tags") if isinstance(found, dict) else None
    if isinstance(tags, str):
        tags = [tags]
    return [t for t in tags if isinstance(t, str) and t.strip()] if isinstance(tags, list) else []


def _parsed(blocks: pd.Series) -> pd.Series:
    known = {b: parse_yaml(b) for b in blocks.unique()}
    return blocks.map(known.get)


def yaml_tags(block: Column | str) -> Column:
    return F.pandas_udf(_parsed, "array<string>")(block)


def line_tags(content: Column | str) -> Column:
    """The chunker's plainer reading: `tags: [a, b]`, `tags: a, b` or one tag; block lists give nothing."""
    value = trim(F.regexp_extract(frontmatter(content), r"(?md)^\s*tags:(.*)$", 1))
    inner = F.regexp_replace(value, r"^\[|\]$", "")
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(trim(x), "^[\"']+|[\"']+$", ""))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def extract(notes: DataFrame) -> DataFrame:
    """(path, file_name, tags) of notes(path, file_name, content) whose frontmatter can be read."""
    ship(notes.sparkSession)
    return notes.select("path", "file_name", yaml_tags(frontmatter("content", closed=True)).alias("tags")).where("tags is not null")


def distinct(tagged: DataFrame) -> DataFrame:
    return tagged.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def counts(tagged: DataFrame, min_count: int | None = None, limit: int | None = None) -> DataFrame:
    """(tag, document_count), most common first; a tag counts once a document."""
    found = tagged.select("path", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.countDistinct("path").alias("document_count"))
    if min_count is not None:
        found = found.where(F.col("document_count") >= min_count)
    found = found.orderBy(F.desc("document_count"), "tag")
    return found if limit is None else found.limit(limit)


def search(tagged: DataFrame, wanted: list[str], match_all: bool = False) -> DataFrame:
    """(path, file_name, matched_tags, all_tags): case is ignored; untagged files never match.

    With an empty list and `match_all`, every tagged file matches.
    """
    low = F.transform("tags", F.lower)
    asked = F.array(*[F.lit(t.lower()) for t in wanted]) if wanted else F.array().cast("array<string>")
    matched = F.filter(asked, lambda t: F.array_contains(low, t))
    enough = F.size(matched) == len(wanted) if match_all else F.size(matched) > 0
    return tagged.where(F.size("tags") > 0).withColumn("matched_tags", matched).where(enough).select("path", "file_name", "matched_tags", F.col("tags").alias("all_tags")).orderBy("path")
