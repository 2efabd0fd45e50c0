"""Every parameter the engine's behaviour depends on, with its default."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChunkConfig:
    max_chars: int = 1200
    min_chars: int = 80
    legacy_chars: int = 900


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class RouteConfig:
    threshold: float = 0.50
    intent_floor: float = 0.50
    intent_gap: float = 0.05
    intents: int = 2


@dataclass(frozen=True)
class FusionConfig:
    semantic: float = 0.7
    lexical: float = 0.3
    main_vector: float = 0.7
    anchor_vector: float = 0.3
    category_bonus: float = 0.10
    topic_bonus: float = 0.03
    anchor_bonus: float = 0.15
    intent_boost: float = 0.08
    title_miss: float = -0.05
    title_hit: float = 0.02
    std_guard: float = 1e-6
    rerank: float = 0.4
    retrieval: float = 0.6
    vector_depth: int = 50
    fused_depth: int = 20
    top_k: int = 5
    min_max_rerank: bool = False
    dedupe_before_limit: bool = False


@dataclass(frozen=True)
class ParseConfig:
    min_section_chars: int = 50
    footnote_window: int = 300
    min_paragraph_chars: int = 100
    default_chapter: str = "General"
    fallback_chapter: str = "Unknown"
    #: Whether "shall come into force" near the start marks a footnote.
    strict_footnotes: bool = True


@dataclass(frozen=True)
class Config:
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    bm25: Bm25Config = field(default_factory=Bm25Config)
    route: RouteConfig = field(default_factory=RouteConfig)
    fusion: FusionConfig = field(default_factory=FusionConfig)
    parse: ParseConfig = field(default_factory=ParseConfig)
