"""Search over the index: sparse, dense or hybrid, with recency, tags and degradation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview
from ..operators import bm25, fusion
from ..operators.vectors import cosine_top_k
from .index import Index


class Mode(Enum):
    SPARSE = "sparse"
    DENSE = "dense"
    HYBRID = "hybrid"


def shown_heading() -> Column:
    """The headings that a chunk stands under, else its own."""
    return F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise(F.col("heading"))


@dataclass(frozen=True)
class Outcome:
    mode_used: Mode
    results: DataFrame


def search(index: Index, query: str, mode: Mode = Mode.HYBRID, limit: int = 50, tags: list[str] | None = None, embed: Callable | None = None, k: float = 60.0, dense_weight: float = 1.0, sparse_weight: float = 1.0, recency: float | None = None, mtimes: DataFrame | None = None, tags_first: bool = False) -> Outcome:
    """(id, source_file, score, heading, tags, date, preview) of the best chunks, best first.

    Without vectors or a working `embed`, dense and hybrid become sparse. Tags are asked for after
    the best are taken, so fewer than `limit` may be left; `tags_first` asks before. `recency` is the
    weight of a chunk's date (its frontmatter's, else its file's in `mtimes`).
    """
    stored = index.table("chunks")
    if stored is None:
        return Outcome(mode, index.spark.createDataFrame([], "id string, source_file string, score double, heading string, tags array<string>, date long, preview string"))
    all_chunks = stored.withColumn("chunk", F.struct("source_file", "seq"))
    has_all = F.array(*[F.lit(t.lower()) for t in tags or []])
    tagged = F.forall(has_all, lambda t: F.array_contains(F.transform("tags", F.lower), t)) if tags else F.lit(True)
    searched = all_chunks.where(tagged) if tags_first else all_chunks
    vector = None
    if mode is not Mode.SPARSE:
        ready = index.table("meta").first()["has_embeddings"] and embed is not None
        try:
            vector = embed([f"query: {query}"])[0] if ready else None
        except Exception:  # whatever the endpoint fails with, the search goes on without it
            vector = None
        mode = mode if vector is not None else Mode.SPARSE
    sparse = dense = None
    if mode is not Mode.DENSE:
        sparse = bm25.scores_from_index(index.table("postings"), index.table("stats"), query, "chunk")
        if tags and tags_first:
            sparse = sparse.join(searched.select("chunk"), "chunk", "left_semi")
    if mode is not Mode.SPARSE:
        dense = cosine_top_k(searched, vector, limit if mode is Mode.DENSE else 2 * limit, "chunk")
    if recency is None:
        if mode is Mode.HYBRID:
            fused = fusion.fused_top(dense, sparse, "chunk", limit, k, dense_weight, sparse_weight)
        else:
            one, weight = (sparse, sparse_weight) if mode is Mode.SPARSE else (dense, dense_weight)
            fused = fusion.rrf([(fusion.ranked(one, "chunk", limit), weight)], "chunk", k)
    else:  # dates may lift any candidate, so all are ranked
        lists = [(fusion.ranked(x, "chunk"), w) for x, w in ((dense, dense_weight), (sparse, sparse_weight)) if x is not None]
        dates = all_chunks.select("chunk", "source_file", "date")
        if mtimes is not None:
            dates = dates.join(mtimes.select(F.col("path").alias("source_file"), F.unix_seconds("mtime").alias("_m")), "source_file", "left").withColumn("date", F.coalesce("date", "_m"))
        fused = fusion.recency_boost(fusion.rrf(lists, "chunk", k), dates, "chunk", recency)
    best = fused.orderBy(F.desc("score"), "chunk").limit(limit)
    found = best.join(all_chunks, "chunk").where(tagged)
    return Outcome(mode, found.orderBy(F.desc("score"), "chunk").select("id", "source_file", "score", shown_heading().alias("heading"), "tags", "date", preview("text").alias("preview")))
