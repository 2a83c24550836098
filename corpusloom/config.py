"""Settings of a retrieval run; all validated on the driver."""

from __future__ import annotations

from dataclasses import dataclass

TIERS = {"simple": "cheap", "normal": "medium", "complex": "expensive"}


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000
    chunk_overlap: int = 150
    embedding_dimensions: int = 384
    embedding_batch_size: int = 64
    dense_top_k: int = 20
    bm25_top_k: int = 20
    fusion_top_k: int = 20
    rerank_top_k: int = 8
    rrf_k: int = 60
    dense_weight: float = 0.6
    lexical_weight: float = 0.4
    context_token_budget: int = 12_000
    keep_similarity: float = 0.6
    fallback_chain: tuple[str, ...] = ("openai", "groq", "gemini", "vllm")
    tier_providers: tuple[tuple[str, str], ...] = ()
    #: (tier, provider, model): which model a tier asks of a provider, and so which provider it asks first.
    tier_models: tuple[tuple[str, str, str], ...] = ()

    def __post_init__(self) -> None:
        if not self.fallback_chain or len(set(self.fallback_chain)) != len(self.fallback_chain):
            raise ValueError("the fallback chain must name providers, each once")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("the overlap must be shorter than a chunk")
        for name in ("embedding_dimensions", "embedding_batch_size", "dense_top_k", "bm25_top_k", "fusion_top_k", "rerank_top_k", "rrf_k", "context_token_budget"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if ({t for t, _ in self.tier_providers} | {t for t, *_ in self.tier_models}) - set(TIERS):
            raise ValueError("unknown tier")
        if any(not model.strip() for *_, model in self.tier_models):
            raise ValueError("a tier's model must have a name")

    def chain(self, tier: str | None = None) -> list[str]:
        """Providers in order: the tier's own first, if the chain has it."""
        first = dict(self.tier_providers).get(tier) or next((p for t, p, _ in self.tier_models if t == tier), None)
        return [first, *(p for p in self.fallback_chain if p != first)] if first in self.fallback_chain else list(self.fallback_chain)

    def tier_model(self, tier: str | None, provider: str) -> str | None:
        """The model that a tier asks of a provider; None for the provider's own."""
        return next((m for t, p, m in self.tier_models if (t, p) == (tier, provider)), None)
