"""Settings with the defaults that queries use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 512
    chunk_overlap: int = 50
    min_chunk_chars: int = 80
    max_semantic_chars: int = 1200
    breakpoint_percentile: float = 0.95
    top_k: int = 5
    candidate_k: int = 20
    rrf_k: int = 60
    dense_weight: float = 0.7
    sparse_weight: float = 0.3
    gate: float = 0.001
    near_duplicate: float = 0.95
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    window_chars: int = 240_000
    window_overlap: int = 5_000
    rate_limit: int = 20
    broadcast_rows: int = 100_000

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")
        if min(self.dense_weight, self.sparse_weight) < 0:
            raise ValueError("fusion weights can't be negative")


DEFAULTS = Settings()
