"""Layered configuration: defaults, the global TOML file, the vault's own, then the environment."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

# Defaults that results depend on.
DAILY_PATTERNS = ("YYYY-MM-DD.md", "0. PeriodicNotes/YYYY/Daily/MM/YYYY-MM-DD.md")
DEFAULT_TASK_LIMIT = 50
APP = "vaultspark"


@dataclass(frozen=True)
class SearchConfig:
    cache_dir: str = ".vaultspark/search"
    embedding_dim: int = 4096
    max_seq_tokens: int = 512
    chunk_overlap_tokens: int = 64
    min_chunk_tokens: int = 32
    rrf_k: float = 60.0
    max_results: int = 50
    rrf_bm25_weight: float = 1.0
    rrf_cosine_weight: float = 1.0
    merge_threshold: int = 30
    rrf_recency_weight: float = 0.5
    model_id: str = ""
    embedding_api_base: str | None = None
    embedding_api_key: str | None = None


@dataclass(frozen=True)
class Config:
    exclude_paths: tuple[str, ...] = ()
    exclude_headings: tuple[str, ...] = ()
    daily_note_patterns: tuple[str, ...] = DAILY_PATTERNS
    search: SearchConfig = field(default_factory=SearchConfig)

    def merged(self, layer: Mapping) -> Config:
        """List keys append, scalars replace; keys that are unknown or of another type are passed over."""
        lists = {k: (*getattr(self, k), *map(str, layer[k])) for k in ("exclude_paths", "exclude_headings", "daily_note_patterns") if isinstance(layer.get(k), list)}
        given = layer.get("search")
        known = {f.name for f in fields(SearchConfig)}
        search = replace(self.search, **{k: v for k, v in given.items() if k in known}) if isinstance(given, Mapping) else self.search
        return replace(self, **lists, search=search)

    def excludes_heading(self, title: str) -> bool:
        low = title.lower()
        return any(p.lower() in low for p in self.exclude_headings)


def _toml(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        return {}


def _from_env(config: Config, env: Mapping[str, str], app: str) -> Config:
    """<APP>_<KEY>: comma-separated lists append; numbers that cannot be read are passed over."""
    layer: dict = {"search": {}}
    for key in ("exclude_paths", "exclude_headings", "daily_note_patterns"):
        if value := env.get(f"{app.upper()}_{key.upper()}"):
            layer[key] = [x.strip() for x in value.split(",") if x.strip()]
    for f in fields(SearchConfig):
        value = env.get(f"{app.upper()}_{f.name.upper()}", env.get(f"{app.upper()}_SEARCH_{f.name.upper()}"))
        if value is None:
            continue
        default = getattr(config.search, f.name)
        try:
            layer["search"][f.name] = type(default)(value) if isinstance(default, (int, float)) else value
        except ValueError:
            continue
    return config.merged(layer)


def load(vault: str | os.PathLike, env: Mapping[str, str] | None = None, app: str = APP) -> Config:
    """Layers of `app`: ~/.config/<app>/config.toml, <vault>/.<app>.toml, and variables that begin with <APP>_."""
    env = os.environ if env is None else env
    home = Path(env["XDG_CONFIG_HOME"]) if env.get("XDG_CONFIG_HOME") else Path(env.get("HOME", "~")).expanduser() / ".config"
    config = Config().merged(_toml(home / app / "config.toml"))
    return _from_env(config.merged(_toml(Path(vault) / f".{app}.toml")), env, app)


def task_limit(env: Mapping[str, str] | None = None, app: str = APP) -> int:
    try:
        return int((os.environ if env is None else env).get(f"{app.upper()}_DEFAULT_LIMIT", DEFAULT_TASK_LIMIT))
    except ValueError:
        return DEFAULT_TASK_LIMIT
