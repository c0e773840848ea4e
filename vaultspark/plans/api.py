"""The public operations by name, over a vault: requests are keyword arguments, answers plain data."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from types import UnionType
from typing import get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame

from ..config import task_limit
from ..operators import daily, files, outline, tasks
from ..operators import tags as tag_rows
from ..operators.chunker import ChunkConfig
from ..sources.endpoint import Endpoint
from ..sources.vault import Vault
from .index import Index
from .search import Mode, search


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def search_tasks(vault: Vault, path: str = "", status: str | None = None, due_on: str | None = None, due_before: str | None = None, due_after: str | None = None, completed_on: str | None = None, completed_before: str | None = None, completed_after: str | None = None, tags: list[str] | None = None, exclude_tags: list[str] | None = None, limit: int | None = None) -> list[dict]:
    filters = {"status": status, "due_on": due_on, "due_before": due_before, "due_after": due_after, "completed_on": completed_on, "completed_before": completed_before, "completed_after": completed_after, "tags": tags, "exclude_tags": exclude_tags}
    vault.existing(path)
    return _rows(tasks.search(vault.notes(path), task_limit() if limit is None else limit, **filters))


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def extract_tags(vault: Vault, subpath: str = "") -> dict:
    return {"tags": [r["tag"] for r in tag_rows.distinct(tag_rows.extract(vault.notes(subpath))).collect()]}


def list_tags(vault: Vault, subpath: str = "", min_count: int | None = None, limit: int | None = None) -> dict:
    every = tag_rows.counts(tag_rows.extract(vault.notes(subpath)), min_count)
    total = every.count()
    shown = _rows(every if limit is None else every.limit(limit))
    return {"tags": shown, "total_unique_tags": total, "truncated": len(shown) < total}


def search_by_tags(vault: Vault, tags: list[str], match_all: bool = False, subpath: str = "", limit: int | None = None) -> dict:
    found = tag_rows.search(tag_rows.extract(vault.notes(subpath)), tags, match_all)
    return {"files": _rows(found if limit is None else found.limit(limit)), "total_count": found.count()}


def list_files(vault: Vault, subpath: str = "", max_depth: int | None = None, include_sizes: bool = False) -> dict:
    rows = files.tree_rows(vault.files(subpath), max_depth)
    return {"visual_tree": files.render(rows, subpath or vault.path.rsplit("/", 1)[-1], include_sizes), **_rows(files.tree_totals(rows, max_depth))[0]}


def _shown(vault: Vault, file_paths: list[str]) -> DataFrame:
    """Those of the files that are notes of the vault, without the sections of excluded headings. Only they are read."""
    asked = [vault.inside(p) for p in file_paths if vault.listed(p)]
    return outline.without_sections(vault.read(asked), list(vault.config.exclude_headings))


def _days(vault: Vault, start: str, end: str) -> DataFrame:
    """The notes that stand where the days' notes may: a year of days at most, some paths for each."""
    rows = daily.expected(daily.calendar(vault.spark, start, end), vault.config.daily_note_patterns).collect()
    return _shown(vault, [r["path"] for r in rows])


def read_files(vault: Vault, file_paths: list[str], continue_on_error: bool = False) -> dict:
    """Without `continue_on_error` the first file that cannot be read, or no file at all, is a ValueError."""
    if not file_paths and not continue_on_error:
        raise ValueError("file_paths cannot be empty")
    good, bad = [], {}
    for p in file_paths:
        try:
            vault.inside(p)
            good.append(p)
        except ValueError as e:
            bad[p] = str(e)
    found = {r["file_path"]: r for r in _rows(files.read(_shown(vault, good), good))} if good else {}
    out = [found.get(p) or {"file_path": p, "file_name": _name(p), "success": False, "content": None, "error": bad[p]} for p in file_paths]
    failed = [r for r in out if not r["success"]]
    if failed and not continue_on_error:
        raise ValueError(failed[0]["error"])
    return {"files": out, "total_requested": len(out), "success_count": sum(r["success"] for r in out), "failure_count": len(failed)}


def recent_files(vault: Vault, limit: int = 20, since: str | None = None) -> dict:
    return {"files": _rows(files.recent(vault.notes(), limit, since))}


def get_daily_note(vault: Vault, date: str) -> dict:
    return _rows(daily.get(_days(vault, *daily.bounds(date, date)), date, vault.config.daily_note_patterns))[0]


def search_daily_notes(vault: Vault, start_date: str | None = None, end_date: str | None = None, sort: str = "desc", limit: int = 100, include_content: bool = False) -> dict:
    return {"notes": _rows(daily.search(_days(vault, *daily.bounds(start_date, end_date)), start_date, end_date, sort, limit, include_content, vault.config.daily_note_patterns))}


def get_outline(vault: Vault, file_path: str, hierarchical: bool = False) -> dict:
    note = vault.read([vault.note_path(file_path)])
    rows = _rows(outline.headings(note).orderBy("seq").select("title", "level", "line_number"))
    shown = outline.tree(rows) if hierarchical else rows
    return {"file_path": file_path, "file_name": _name(file_path), "headings": shown, "total_count": len(shown)}


def get_section(vault: Vault, file_path: str, heading: str, include_subsections: bool = False) -> dict:
    found = outline.section(vault.read([vault.note_path(file_path)]), heading, include_subsections)
    sections = _rows(found.orderBy("seq").select("title", "level", "content", "start_line", "end_line"))
    return {"file_path": file_path, "file_name": _name(file_path), "sections": sections, "section_count": len(sections)}


def search_headings(vault: Vault, pattern: str, min_level: int = 1, max_level: int = 6, limit: int | None = None) -> dict:
    rows = _rows(outline.search(vault.notes(), pattern, min_level, max_level, limit))
    return {"matches": rows, "total_count": len(rows)}


def _index(vault: Vault) -> Index:
    s = vault.config.search
    return Index(vault.spark, f"file://{vault.path}/{s.cache_dir}", ChunkConfig.of(vault.config), s.model_id, s.embedding_dim, s.embedding_api_base)


def index(vault: Vault, reindex: bool = False, model: str | None = None, dim: int | None = None, embed: Callable | None = None) -> dict:
    """`embed` is the configured endpoint unless another is given; model and dim replace the configured ones."""
    given = {k: v for k, v in (("model_id", model), ("embedding_dim", dim)) if v is not None}
    vault = Vault(vault.spark, vault.path, replace(vault.config, search=replace(vault.config.search, **given)))
    return asdict(_index(vault).build(vault.notes(), embed or Endpoint.of(vault.config.search), reindex))


def search_notes(vault: Vault, query: str, limit: int | None = None, mode: str = "hybrid", no_reindex: bool = False, tags: list[str] | None = None, enable_recency: bool = False, recency_weight: float | None = None, embed: Callable | None = None) -> dict:
    """Brings the index up to date, unless `no_reindex`, then searches it."""
    s, notes, own = vault.config.search, vault.notes(), _index(vault)
    embed = embed or Endpoint.of(s)
    if not no_reindex:
        own.build(notes, embed)
    weight = (s.rrf_recency_weight if recency_weight is None else recency_weight) if enable_recency else None
    found = search(own, query, Mode(mode), s.max_results if limit is None else limit, tags, embed, s.rrf_k, s.rrf_cosine_weight, s.rrf_bm25_weight, weight, notes)
    return {"mode_used": found.mode_used.value, "results": _rows(found.results)}


#: Command names and what they call.
OPERATIONS: dict[str, Callable] = {
    "tasks": search_tasks, "tags": extract_tags, "list-tags": list_tags, "search-tags": search_by_tags, "list-files": list_files, "read-files": read_files, "recent-files": recent_files,
    "get-daily-note": get_daily_note, "search-daily-notes": search_daily_notes, "outline": get_outline, "section": get_section, "search-headings": search_headings, "index": index, "search": search_notes,
}


@dataclass(frozen=True)
class Field:
    """A parameter of an operation's request."""

    name: str
    kind: type
    required: bool

    @property
    def option(self) -> str:
        return self.name.replace("_", "-")

    def read(self, value):
        """`value` as the parameter's kind, from JSON or from text as in a query string."""
        if value is None or not isinstance(value, str):
            return value
        if self.kind is bool:
            return value.strip().lower() in ("true", "1", "yes")
        if self.kind is list:
            return [x.strip() for x in value.split(",") if x.strip()]
        return self.kind(value)


def fields(name: str) -> list[Field]:
    """The parameters of an operation but for the vault and functions."""
    call = OPERATIONS[name]
    hints = get_type_hints(call)
    found = []
    for p in inspect.signature(call).parameters.values():
        kinds = [k for k in (get_args(hints[p.name]) if isinstance(hints[p.name], UnionType) else [hints[p.name]]) if k is not type(None)]
        kind = get_origin(kinds[0]) or kinds[0]
        if kind in (str, int, float, bool, list):
            found.append(Field(p.name, kind, p.default is p.empty))
    return found


def execute(vault: Vault, name: str, request: str | dict) -> str:
    """JSON in, JSON out. Absent and null parameters take their defaults; unknown ones are passed over; a missing one is a ValueError."""
    asked = json.loads(request) if isinstance(request, str) else request
    given = {f.name: f.read(asked[f.name]) for f in fields(name) if asked.get(f.name) is not None}
    for f in fields(name):
        if f.required and f.name not in given:
            raise ValueError(f"missing parameter: {f.name}")
    return json.dumps(OPERATIONS[name](vault, **given), default=str, ensure_ascii=False, indent=2)
