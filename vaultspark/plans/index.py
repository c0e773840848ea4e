"""The search index: Parquet tables in versioned folders, brought up to date by content hash."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25
from ..operators.chunker import ChunkConfig, chunks
from ..workers import ship

FORMAT = 4
TABLES = ("files", "chunks", "postings", "stats", "meta")
EMBED_ROWS = 32
#: Changed paths that are sent to all workers at most, so that what did not change is not shuffled; more are joined as Spark sees fit.
FEW_PATHS = 1 << 18


def content_hash(content: str = "content") -> Column:
    return F.sha2(F.col(content).cast("binary"), 256)


def hashes(notes: DataFrame) -> DataFrame:
    return notes.select("path", content_hash().alias("content_hash"), "mtime")


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed, by content_hash; files that are the same have no row."""
    old = before.select("path", F.col("content_hash").alias("old"))
    both = now.select("path", F.col("content_hash").alias("new")).join(old, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def overall_hash(hashed: DataFrame) -> DataFrame:
    """One row (content_hash): equal for two vaults if their paths and contents are.

    Of the paths and hashes, in order, of each of 4096 parts of the paths' hashes, and then of the parts'.
    """
    ordered = F.array_sort(F.collect_list(F.struct("path", "content_hash")))
    joined = F.array_join(F.transform(ordered, lambda x: F.concat(x["path"], F.lit(":"), x["content_hash"])), "\n")
    parts = hashed.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("part")).agg(F.sha2(joined, 256).alias("h"))
    every = F.array_sort(F.collect_list(F.struct("part", "h")))  # 4096 at most
    return parts.agg(F.sha2(F.array_join(F.transform(every, lambda x: x["h"]), ""), 256).alias("content_hash"))


@dataclass(frozen=True)
class Summary:
    status: str
    added: int
    modified: int
    removed: int
    chunks: int
    has_embeddings: bool
    duration_ms: int


class Index:
    """Tables below `base`: v=<id>/<table>, and a one-row table `current` that names the version in use.

    A version is complete before it is named, so a reader or a run that fails sees the one before.
    """

    def __init__(self, spark: SparkSession, base: str, chunking: ChunkConfig, model_id: str = "", embedding_dim: int = 0, api_base: str | None = None):
        self.spark, self.base, self.chunking = spark, base.rstrip("/"), chunking
        self.key = repr((FORMAT, model_id, embedding_dim, api_base, sorted(asdict(chunking).items())))

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def version(self) -> str | None:
        if not self._exists(f"{self.base}/current"):
            return None
        row = self.spark.read.parquet(f"{self.base}/current").orderBy(F.desc("at")).first()
        return row["version"] if row else None

    def table(self, name: str) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.base}/v={v}/{name}") if v else None

    def staleness(self, notes: DataFrame) -> tuple[str, DataFrame]:
        """FullRebuild (no index, or one of other parameters), Stale or UpToDate; and the changes."""
        now, meta = hashes(notes), self.table("meta")
        if meta is None or meta.first()["key"] != self.key:
            return "FullRebuild", now.select("path", F.lit("added").alias("change"))
        changes = diff(now, self.table("files"))
        return ("Stale" if changes.limit(1).count() else "UpToDate"), changes

    def build(self, notes: DataFrame, embed: Callable | None = None, reindex: bool = False) -> Summary:
        """Chunk what changed, keep the rest, write the next version. `embed` maps texts to vectors, in batches.

        If the first batch cannot be embedded the new chunks get no vectors; a later failure ends the
        build and leaves the version in use. The index has embeddings if every chunk has its vector.
        """
        began = time.time()
        state, changes = ("FullRebuild", hashes(notes).select("path", F.lit("added").alias("change"))) if reindex else self.staleness(notes)
        count = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
        if state == "UpToDate":
            meta = self.table("meta").first()
            return Summary(state, 0, 0, 0, self.table("chunks").count(), meta["has_embeddings"], int(1000 * (time.time() - began)))
        ship(self.spark)
        few = F.broadcast if sum(count.values()) <= FEW_PATHS else lambda df: df
        if state == "FullRebuild":
            todo = chunks(notes.where("path is not null"), self.chunking)
        else:
            todo = chunks(notes.join(few(changes.where("change <> 'removed'").select("path")), "path", "left_semi"), self.chunking)
        kept = None
        if state == "Stale":
            kept = self.table("chunks").join(few(changes.select(F.col("path").alias("source_file"))), "source_file", "left_anti")
            if embed is not None:  # chunks of a build that had no vectors get theirs now
                todo = todo.unionByName(kept.where("embedding is null").drop("embedding"))
                kept = kept.where("embedding is not null")
        made = self._embedded(todo, embed if embed is not None and self._embeds(todo, embed) else None)
        made = made if kept is None else made.unionByName(kept)
        v = f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        at = f"{self.base}/v={v}"
        made.write.parquet(f"{at}/chunks")
        written = self.spark.read.parquet(f"{at}/chunks")
        has = not written.isEmpty() and written.where("embedding is null").isEmpty()
        searched = written.select(F.struct("source_file", "seq").alias("chunk"), searchable().alias("text"))
        bm25.write_index(searched, at, "chunk")
        hashes(notes).write.parquet(f"{at}/files")
        self.spark.range(1).select(F.lit(self.key).alias("key"), F.lit(has).alias("has_embeddings")).write.parquet(f"{at}/meta")
        before = self.version()
        self.spark.range(1).select(F.lit(v).alias("version"), F.lit(time.time()).alias("at")).coalesce(1).write.mode("append").parquet(f"{self.base}/current")
        self._tidy({v} if reindex else {v, before})
        return Summary(state, count.get("added", 0), count.get("modified", 0), count.get("removed", 0), written.count(), has, int(1000 * (time.time() - began)))

    def _embeds(self, todo: DataFrame, embed: Callable) -> bool:
        first = [r["passage"] for r in todo.select(passage().alias("passage")).limit(EMBED_ROWS).collect()]
        try:
            return not first or len(embed(first)) == len(first)
        except Exception:  # whatever the endpoint fails with, the index is built without it
            return False

    def _embedded(self, todo: DataFrame, embed: Callable | None) -> DataFrame:
        whole = todo.withColumn("embedding", F.lit(None).cast("array<float>"))
        if embed is None:
            return whole

        def run(batches):
            for pdf in batches:
                asked, vectors = list(pdf["passage"]), []
                for a in range(0, len(asked), EMBED_ROWS):
                    vectors += embed(asked[a : a + EMBED_ROWS])
                yield pdf.drop(columns="passage").assign(embedding=[list(map(float, v)) for v in vectors])

        return todo.withColumn("passage", passage()).mapInPandas(run, whole.schema)

    def _tidy(self, keep: set) -> None:
        """Remove versions but those kept (the one before is, for who reads it just now), and all but the last names."""
        fs, at = self._fs(self.base)
        for x in fs.listStatus(at):
            if (name := x.getPath().getName()).startswith("v=") and name[2:] not in keep:
                fs.delete(x.getPath(), True)
        _, current = self._fs(f"{self.base}/current")
        parts = sorted((x for x in fs.listStatus(current) if x.getPath().getName().startswith("part-")), key=lambda x: (x.getModificationTime(), x.getPath().getName()))
        for x in parts[:-2]:
            fs.delete(x.getPath(), False)

    def clear(self) -> None:
        fs, at = self._fs(self.base)
        fs.delete(at, True)


def passage() -> Column:
    """What is embedded of a chunk: its text below the headings it stands under, or the file's name without its ending."""
    name = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")
    title = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise(name)
    return F.concat(F.lit("passage: "), title, F.lit("\n"), F.col("text"))


def searchable() -> Column:
    """What is ranked of a chunk: its text, after its tags if it has any."""
    return F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join("tags", " "), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
