"""Settings that change results. Defaults are fixed values of the engine's contract; every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 1500
    chunk_overlap: int = 200
    link_threshold: float = 0.70
    link_top_n: int = 5
    link_fetch_k: int = 40
    rerank_candidates: int = 30
    relevance_ratio: float = 0.25
    relevance_min: float = 0.01
    synth_window_chunks: int = 10
    max_claims: int = 12
    synth_max_chunks: int = 40
    synth_chunk_chars: int = 1200
    salience_windows: int = 2
    salience_claims: int = 2
    salience_floor: int = 5
    topic_min_entities: int = 5
    topic_max_entities: int = 15
    topic_max_pages: int = 30
    source_max_entities: int = 15
    source_max_chapters: int = 40
    page_min_score: float = 0.30
    query_dup_threshold: float = 0.85
    tau_high: float = 0.85
    tau_low: float = 0.45
    margin: float = 0.15
    block_k: int = 10
    weight_alias: float = 0.35
    weight_lexical: float = 0.15
    weight_embed: float = 0.40
    weight_comention: float = 0.10
    fold_cut: float = 0.70
    dup_jaccard: float = 0.5
    cluster_threshold: float = 0.92
    provenance_cap: int = 25
    figure_min_px: int = 64
    rrf_k: int = 60
    comention_cap: int = 12


DEFAULTS = Settings()
