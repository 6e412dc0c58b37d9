"""Thresholds of the engine. The numbers are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CleanConfig:
    garbage_threshold: float = 0.45
    boilerplate_min_pages: int = 3
    boilerplate_min_share: float = 0.15
    boilerplate_max_chars: int = 120
    duplicate_min_chars: int = 40
    orphan_max_chars: int = 15
    fragment_max_chars: int = 25
    caption_max_chars: int = 40
    min_lm_chars: int = 30
    min_train_chars: int = 200
    same_line_overlap: float = 0.5
    same_line_gap: float = 2.5
    paragraph_gap: float = 2.0
    paragraph_overlap: float = 0.3
    default_line_height: float = 12.0
    minhash_permutations: int = 128
    shingle_words: int = 5
    shingle_modulus: int = 8
    similar_threshold: float = 0.5
    copy_threshold: float = 0.99


@dataclass(frozen=True)
class RetrievalConfig:
    candidates: int = 40
    top_k: int = 8
    rrf_k: int = 60
    gate: float = 0.55
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    judge_threshold: float = 0.82
    max_iterations: int = 3
    seeds: int = 12
    paths: int = 40
    facts_per_relation: int = 3


@dataclass(frozen=True)
class ChunkConfig:
    max_tokens: int = 650
    overlap_sentences: int = 2
    overlap_share: float = 0.15
    context_chars: int = 400
    context_blocks: int = 2
    parent_chars: int = 4000


FURNITURE_TYPES = ("Header", "Footer", "PageBreak", "PageNumber")
CAPTION_TYPES = ("FigureCaption", "Caption")
PROSE_TYPES = ("NarrativeText", "ListItem")
MERGEABLE_TYPES = ("NarrativeText", "ListItem", "UncategorizedText")
DROP_REASONS = ("empty", "garbage", "furniture", "caption_only", "boilerplate", "merged", "duplicate", "orphan", "duplicate_document")
CLEAN = CleanConfig()
RETRIEVAL = RetrievalConfig()
CHUNK = ChunkConfig()
