"""Settings, read from the environment when an object is made."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def env_bool(name: str, default: bool = False) -> bool:
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def env_int(name: str, default: int | None) -> int | None:
    try:
        return int(os.environ[name])
    except (KeyError, ValueError):
        return default


def env_float(name: str, default: float) -> float:
    try:
        return float(os.environ[name])
    except (KeyError, ValueError):
        return default


@dataclass
class RetrievalConfig:
    """Retrieval: pool, threshold, legs, filters and what follows them."""

    top_k: int = field(default_factory=lambda: env_int("RAG_TOP_K", 20))
    score_threshold: float = field(default_factory=lambda: env_float("RAG_SCORE_THRESHOLD", 0.1))
    hybrid_search: bool = field(default_factory=lambda: env_bool("HYBRID_SEARCH", True))
    hybrid_prefetch: int = field(default_factory=lambda: env_int("HYBRID_PREFETCH_LIMIT", 50))
    text_mode: str = "match"
    vector_name: str = "vector"
    final_contexts: int = field(default_factory=lambda: env_int("FINAL_CONTEXT_LIMIT", 5))
    adaptive: bool = False
    adaptive_min_keep: int = 3
    adaptive_score_ratio: float = 0.0
    adaptive_score_drop: float = 0.0
    max_chunks_per_doc: int = 0
    rerank_top_n: int = 0
    dedupe_tables: bool = False


@dataclass
class CostConfig:
    price_in: float = 0.0008
    price_out: float = 0.004


def normalize_ks(values: list[int], top_k: int) -> tuple[list[int], int]:
    """Positive, unique, ascending k values, and a top_k that covers them."""
    ks = sorted({k for k in values if k > 0})
    if not ks:
        raise ValueError("no positive k")
    return ks, max(top_k, ks[-1])
