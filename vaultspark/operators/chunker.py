"""Chunks of notes: sections within a token budget, tiny ones merged, long ones in overlapping windows."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.dates import frontmatter_date
from ..functions.text import MAX_WORD, budget_tokens, low_semantic_value, windows
from ..workers import ship
from .outline import with_sections
from .tags import line_tags

# Fixed value: words for each byte below which a chunk is left out.
LEAST_DENSITY = 0.03
#: Characters of chunks that a worker holds before it gives them out.
OUT_SIZE = 1 << 20
_PIECE = re.compile(rf"\S{{1,{MAX_WORD}}}")


@dataclass(frozen=True)
class ChunkConfig:
    max_tokens: int = 512
    overlap_tokens: int = 50
    min_chunk_size: int = 50
    merge_threshold: int = 30
    exclude_headings: tuple[str, ...] = ()

    @classmethod
    def of(cls, config: Config) -> ChunkConfig:
        s = config.search
        return cls(s.max_seq_tokens, s.chunk_overlap_tokens, s.min_chunk_tokens, s.merge_threshold, config.exclude_headings)

    def excluded(self, title: str) -> bool:
        return any(p.lower() in title.lower() for p in self.exclude_headings)


class Passage:
    """A text as pieces of words, with the lines that they stand on."""

    def __init__(self, parts: list[tuple[str, int]]):
        """parts: texts and the line that each begins after."""
        self.text = "\n\n".join(t for t, _ in parts)
        self.begin, self.end, self.line = array("q"), array("q"), array("q")  # of each piece
        at = 0
        for text, line in parts:
            seen = 0
            for m in _PIECE.finditer(text):
                a, b = m.span()
                line += text.count("\n", seen, a)  # there is none in a piece
                seen = b
                self.begin.append(at + a)
                self.end.append(at + b)
                self.line.append(line)
            at += len(text) + 2

    def __len__(self) -> int:
        return len(self.begin)

    def windows(self, most: int, overlap: int) -> list[tuple[int, int]]:
        overlap = min(overlap, most - 1)
        return [(a, min(a + most, len(self))) for a in range(0, max(0, len(self) - overlap - 1) + 1, most - overlap)]

    def joined(self, a: int, b: int) -> str:
        return " ".join(self.text[s:e] for s, e in zip(self.begin[a:b], self.end[a:b]))

    def sparse(self, a: int, b: int) -> bool:
        """Whether the stretch of the pieces has hardly any words for its bytes, as data rather than prose has."""
        stretch = self.text[self.begin[a] : self.end[b - 1]]
        return len(stretch.split()) / len(stretch.encode()) < LEAST_DENSITY


def chunk(path: str, found: list[dict], config: ChunkConfig) -> Iterator[dict]:
    """Chunks of one note with headings; `found` are its sections in order (level, title, content, start_line, end_line)."""
    above: list[tuple[int, str]] = []
    at = 0
    while at < len(found):
        own = found[at]
        at += 1
        if config.excluded(own["title"]):
            continue
        while above and above[-1][0] >= own["level"]:
            above.pop()
        trail = [t for _, t in above]
        above.append((own["level"], own["title"]))
        body = Passage([(own["content"], own["start_line"])])
        end, kind, merged = own["end_line"], "section", False
        if len(body) < config.merge_threshold and at < len(found):
            after = found[at]
            both = Passage([(own["content"], own["start_line"]), (after["content"], after["start_line"])])
            if len(both) <= 2 * config.max_tokens:
                body, end, kind, merged = both, after["end_line"], "merged", True
                at += 1
        split = len(body) > config.max_tokens
        cut = body.windows(config.max_tokens, config.overlap_tokens) if split else [(0, len(body))]
        for j, (a, b) in enumerate(cut):
            if not merged and len(cut) == 1 and b - a < config.min_chunk_size:
                continue
            if a < b and body.sparse(a, b):
                continue
            first, last = (body.line[a], body.line[b - 1]) if a < b else (own["start_line"], end)
            label = trail[-1] if trail else kind
            yield {"id": f"{path}:{own['start_line'] + j}:{label}", "line_start": first, "line_end": last, "heading": own["title"], "heading_path": trail, "text": body.joined(a, b) if split else body.text}


def chunk_whole(path: str, content: str, config: ChunkConfig) -> Iterator[dict]:
    """Chunks of one note without headings: windows that do not overlap, on lines counted from 0."""
    body = Passage([(content, 0)])
    for a in range(0, len(body), config.max_tokens):
        b = min(a + config.max_tokens, len(body))
        if b - a >= config.min_chunk_size and not body.sparse(a, b):
            first, last = body.line[a], body.line[b - 1]
            yield {"id": f"{path}:{first}", "line_start": first, "line_end": last, "heading": None, "heading_path": [], "text": body.joined(a, b)}

def chunked(batches: Iterator[pa.RecordBatch], config: ChunkConfig) -> Iterator[pa.RecordBatch]:
    """Chunks of notes (path, content or else sections, tags, date): one note at a time is taken up, some `OUT_SIZE` characters are given out."""
    for batch in batches:
        out, size = [], 0
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            r["path"], own = r["path"] or "", r["path"]
            made = chunk_whole(r["path"], r["content"], config) if r["sections"] is None else chunk(r["path"], r["sections"], config)
            for i, c in enumerate(made):
                out.append({**c, "id": c["id"] if own is not None else None, "source_file": own, "seq": i, "tags": r["tags"], "date": r["date"]})
                size += len(c["text"])
                if size >= OUT_SIZE:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def chunks(notes: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(id, source_file, seq, line_start, line_end, heading, heading_path, tags, date, text) of notes(path, content).

    Greedy merging follows a note's sections in order, so a note is chunked by one call; notes are
    never brought together. A worker takes one note of its Arrow batch at a time and gives chunks out by
    the megabyte; a note comes as its content or as its sections, not as both. Repeated paths are chunked each; a null content gives no chunk, a null
    path chunks whose source and id are null.
    """
    ship(notes.sparkSession)
    split = with_sections(notes.where("content is not null").select("path", "content"), "sections")
    plain = F.forall("sections", lambda s: s["title"] == "")
    whole = split.select("path", F.when(plain, F.col("content")).alias("content"), line_tags("content").alias("tags"), frontmatter_date("content").alias("date"), F.when(~plain, F.col("sections")).alias("sections"))
    return whole.mapInArrow(lambda batches: chunked(batches, config), SCHEMA)


SCHEMA = "id string, source_file string, seq int, line_start int, line_end int, heading string, heading_path array<string>, tags array<string>, date long, text string"
_ARROW = pa.schema([("id", pa.string()), ("source_file", pa.string()), ("seq", pa.int32()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("heading", pa.string()), ("heading_path", pa.list_(pa.string())), ("tags", pa.list_(pa.string())), ("date", pa.int64()), ("text", pa.string())])


def windowed(docs: DataFrame, most: int, overlap: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, start, stop, text): budget windows of plain texts, all in built-in expressions."""
    tokens = budget_tokens(F.coalesce(F.col(text), F.lit("")))
    return docs.select(key, tokens.alias("_t")).select(key, F.explode(windows(F.col("_t"), most, overlap)).alias("w")).select(key, "w.*")


def low_value(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, low_semantic_value(F.coalesce(F.col(text), F.lit(""))).alias("low_value"))
