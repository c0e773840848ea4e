"""Vectors of texts from an HTTP endpoint of the common embeddings interface."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

import numpy as np

from ..config import SearchConfig

# Fixed value: a model that is not loaded can take minutes to answer its first request.
TIMEOUT_SECONDS = 600


@dataclass(frozen=True)
class Endpoint:
    """Maps a list of texts to their vectors, cut to `dim` components and of unit length; for driver and executors alike."""

    base: str
    model: str = ""
    dim: int = 0
    key: str | None = None
    timeout: float = TIMEOUT_SECONDS

    @classmethod
    def of(cls, config: SearchConfig) -> Endpoint | None:
        """The configured endpoint, if there is one."""
        if config.embedding_api_base is None:
            return None
        return cls(config.embedding_api_base, config.model_id, config.embedding_dim, config.embedding_api_key)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        """In the order of `texts`. An OSError if the endpoint fails, a ValueError if its answer is not one vector a text."""
        if not texts:
            return []
        headers = {"Content-Type": "application/json"}
        if self.key:
            headers["Authorization"] = f"Bearer {self.key}"
        body = json.dumps({"model": self.model, "input": texts}).encode()
        asked = urllib.request.Request(f"{self.base.rstrip('/')}/embeddings", body, headers, method="POST")
        with urllib.request.urlopen(asked, timeout=self.timeout) as reply:
            rows = json.load(reply)["data"]
        rows = sorted(rows, key=lambda r: r["index"])
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
        return [unit(r["embedding"], self.dim) for r in rows]


def unit(vector: list[float], dim: int = 0) -> list[float]:
    """The first `dim` components (0: all) scaled to unit length; zeros where the length is 1e-10 or less."""
    v = np.array(vector[:dim] if dim else vector, np.float64)
    length = np.sqrt((v * v).sum())
    return (v / length if length > 1e-10 else np.zeros_like(v)).tolist()
