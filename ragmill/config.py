"""Settings of the engine, read from the environment and validated."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from ragmill.messages import OVERLAP

# Environment variable and default of every setting.
ENVIRONMENT = {
    "port": ("PORT", 3000),
    "chunk_size": ("CHUNK_SIZE", 1000),
    "chunk_overlap": ("CHUNK_OVERLAP", 0),
    "top_k": ("RAG_TOP_K", 3),
    "embedding_model": ("EMBEDDING_MODEL", ""),
    "generation_model": ("GENERATION_MODEL", ""),
    "document_key": ("GEMINI_API_KEY", ""),
    "model_host": ("OLLAMA_HOST", "http://localhost:11434"),
    "store_host": ("CHROMADB_HOST", "localhost"),
    "store_port": ("CHROMADB_PORT", 8000),
    "collection": ("CHROMA_COLLECTION", "docs"),
    "max_tokens": ("MAX_TOKENS", 1000),
    "threshold": ("RETRIEVAL_THRESHOLD", 0.35),
}


@dataclass(frozen=True)
class EngineConfig:
    port: int = 3000
    chunk_size: int = 1000
    chunk_overlap: int = 0
    top_k: int = 3
    embedding_model: str = ""
    generation_model: str = ""
    #: Key of the service that embeds documents for retrieval; a model server needs none.
    document_key: str = ""
    model_host: str = "http://localhost:11434"
    store_host: str = "localhost"
    store_port: int = 8000
    collection: str = "docs"
    #: Carried into the prompt's context; no model receives it.
    max_tokens: int = 1000
    threshold: float = 0.35

    def __post_init__(self) -> None:
        if self.chunk_size < 1:
            raise ValueError("chunk_size must be at least 1")
        if self.chunk_overlap < 0:
            raise ValueError("chunk_overlap must not be negative")
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError(OVERLAP)
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")
        if math.isnan(self.threshold):
            raise ValueError("threshold must be a number")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        """Settings from environment variables; a value that is not a number where one is due raises."""
        env = os.environ if env is None else env
        values = {}
        for f in fields(cls):
            name, default = ENVIRONMENT[f.name]
            raw = env.get(name)
            if raw is None or raw == "":
                continue
            try:
                values[f.name] = type(default)(raw)
            except ValueError:
                raise ValueError(f"{name}={raw!r} is not a {type(default).__name__}") from None
        return cls(**values)
