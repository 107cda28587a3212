"""Settings that change results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    enable_vector: bool = False
    embed_dim: int = 1024
    rrf_k: int = 60
    result_limit: int = 20
    merge_threshold: float = 0.90
    suggest_threshold: float = 0.65
    index_k_anonymity: int = 2
    ai_mode: str = "extractive"
    persist_index: bool = False
    enable_encryption: bool = True
