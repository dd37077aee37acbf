"""Defaults of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults of ingest, snapshots and admission; callers pass other values as arguments. Nothing reads the environment."""

    chunk_chars: int = 2500
    chunk_overlap: int = 250
    max_chunks: int = 30
    min_confidence: float = 0.5
    merge_alpha: float = 0.7
    merge_threshold: float = 0.85
    damping: float = 0.85
    snapshot_ttl: float = 300.0
    rate_window: float = 60.0
    rate_limit: int = 30
    scrape_queries: str = ""

    def queries(self) -> list[str]:
        """The harvest's queries, which are separated by semicolons."""
        return [q for q in map(str.strip, self.scrape_queries.split(";")) if q]
