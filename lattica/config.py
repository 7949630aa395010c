"""Settings: defaults, then a TOML file, then environment variables."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace

from lattica.operators.chunking import ChunkConfig
from lattica.operators.fusion import RetrievalConfig


@dataclass(frozen=True)
class EmbeddingConfig:
    # Defaults of the external services.
    provider: str = "openai"
    model: str = "gpt-4o-mini"
    embedding_model: str = "text-embedding-3-small"
    vector_dimension: int = 1536
    max_tokens: int = 2048
    temperature: float = 0.1
    api_key: str | None = field(default=None, repr=False)


@dataclass(frozen=True)
class Settings:
    retrieval: RetrievalConfig = RetrievalConfig()
    chunking: ChunkConfig = ChunkConfig()
    models: EmbeddingConfig = EmbeddingConfig()


# Table of the settings file -> part of the settings, and names that differ.
_SECTIONS = {"rag": "retrieval", "chunking": "chunking", "llm": "models"}
_RENAMED = {("rag", "chunk_size"): ("chunking", "chunk_size"), ("rag", "chunk_overlap"): ("chunking", "overlap"),
            ("database", "vector_dimension"): ("models", "vector_dimension")}
_ENVIRONMENT = {"OPENAI_API_KEY": ("models", "api_key"), "LLM_MODEL": ("models", "model"), "EMBEDDING_MODEL": ("models", "embedding_model")}


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Settings with unknown keys ignored."""
    changes: dict[str, dict] = {"retrieval": {}, "chunking": {}, "models": {}}
    if path is not None:
        with open(path, "rb") as handle:
            data = tomllib.load(handle)
        for section, values in data.items():
            for key, value in values.items() if isinstance(values, dict) else ():
                part, name = _RENAMED.get((section, key), (_SECTIONS.get(section), key))
                if part is not None:
                    changes[part][name] = value
    env = os.environ if environment is None else environment
    for variable, (part, name) in _ENVIRONMENT.items():
        if env.get(variable):
            changes[part][name] = env[variable]
    settings = Settings()
    for part, values in changes.items():
        known = {f.name for f in fields(getattr(settings, part))}
        settings = replace(settings, **{part: replace(getattr(settings, part), **{k: v for k, v in values.items() if k in known})})
    return settings
