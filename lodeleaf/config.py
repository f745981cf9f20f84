"""Settings of retrieval, with defaults, and the keyword configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class KeywordConfig:
    """Word lists as data; synonyms map a word to others, priority words weigh more in a path."""

    stopwords: tuple[str, ...] = (
        "and", "are", "but", "como", "con", "dans", "das", "der", "die", "ein", "eine", "est", "for", "from", "las", "les",
        "los", "mit", "not", "nicht", "para", "pour", "por", "que", "sich", "the", "that", "this", "une", "und", "was", "with",
    )
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    priority: tuple[str, ...] = ()

    @classmethod
    def read(cls, folder: str | Path) -> KeywordConfig:
        """stopwords.json and priority_keywords.json (arrays of strings), domain_synonyms.json (object of arrays); all three are needed."""
        load = lambda name: json.loads(Path(folder, f"{name}.json").read_text(encoding="utf-8"))
        stop, priority, synonyms = load("stopwords"), load("priority_keywords"), load("domain_synonyms")
        is_words = lambda x: isinstance(x, list) and all(isinstance(w, str) for w in x)
        if not is_words(stop) or not is_words(priority):
            raise ValueError("stopwords and priority keywords have to be arrays of strings")
        if not isinstance(synonyms, dict) or not all(map(is_words, synonyms.values())):
            raise ValueError("synonyms have to be an object of arrays of strings")
        return cls(tuple(stop), {k: tuple(v) for k, v in synonyms.items()}, tuple(priority))


@dataclass(frozen=True)
class Settings:
    """Limits of the retrieval pipeline."""

    k: int = 20
    wide_k: int = 150
    strong_sources: int = 3
    context_chunks: int = 5
    wide_appended: int = 20
    path_sources: int = 12
    path_chunks_per_source: int = 2
    path_chunks: int = 12
    path_tokens: int = 12
    prefix_length: int = 5
    code_chunks: int = 12
    literal_per_term: int = 10
    literal_total: int = 20
    literal_length: int = 4
    duplicate_above: float = 0.6
    max_keywords: int = 7
    greeting_length: int = 60
    conversation_chars: int = 4000
    chunk_chars: int = 1500
    chunk_overlap: int = 300

    def overlay(self, *layers: dict[str, object]) -> Settings:
        """These settings with layers on top, later ones first; unknown names are ignored."""
        known = {f.name for f in fields(self)}
        merged = {k: v for layer in layers for k, v in layer.items() if k in known}
        return replace(self, **merged)


def effective(layers: list[dict[str, str]], secret: tuple[str, ...] = ("KEY", "TOKEN", "SECRET", "PASSWORD")) -> dict[str, str]:
    """Names and values of environment layers, later ones on top, sorted, without secrets."""
    merged = {k: v for layer in layers for k, v in layer.items()}
    return {k: merged[k] for k in sorted(merged) if not any(s in k.upper() for s in secret)}
