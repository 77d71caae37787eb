"""Defaults of the operators."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    chunk_size: int = 500
    chunk_overlap: int = 50
    min_chunk_chars: int = 30
    rerank_top_k: int = 12
    max_sources: int = 8
    max_chunks: int = 12
    results_per_domain: int = 2
    scrape_top_n: int = 2
    max_sub_queries: int = 4
    doc_chars: int = 12_000
    ttl_time_sensitive_s: int = 900
    ttl_s: int = 21_600
    similarity: float = 0.92
    word_overlap: float = 0.3
    index_cap: int = 300
    semantic_age_s: int = 120
    rate_limit: int = 30
    rate_window_s: int = 3600
    latest_turns: int = 200
    history_turns: int = 4
    trace_sources: int = 25
    preview_chars: int = 180


DEFAULTS = Defaults()
