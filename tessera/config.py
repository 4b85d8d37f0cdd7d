"""Defaults of every stage, as frozen values; a stage takes one of these. `Config.load` reads other values from a file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Cleaning:
    margin_top: float = 55.0
    margin_bottom: float = 35.0
    repeat_threshold: int = 3
    repeat_max_words: int = 10
    page_height: float = 792.0
    footer_band: float = 28.0
    footer_max_words: int = 8
    known_artifacts: tuple[str, ...] = ("Ü",)
    noise_patterns: tuple[str, ...] = (r"\d+", r"[\x{ae}Ü\x{2022}*=\-_/|]+")
    navigation: tuple[str, ...] = ("available online", "connect with us", "please take a moment", "share with us")


@dataclass(frozen=True)
class Headings:
    min_font_delta: float = 1.5
    max_words: int = 14
    caps_max_words: int = 8
    title_ratio: float = 0.6
    breadcrumb: str = "»"
    breadcrumb_max_y: float = 80.0
    boilerplate: tuple[str, ...] = ()


@dataclass(frozen=True)
class Chunking:
    min_words: int = 80
    target_words: int = 180
    max_words: int = 300
    overlap_sentences: int = 1
    tiny_words: int = 40
    # fixed values: shares of terms in common below which a sentence opens something new, alone or with a new paragraph
    apart: float = 0.08
    weakly_apart: float = 0.15
    window_words: int = 200


@dataclass(frozen=True)
class Validation:
    heading_min_words: int = 2
    heading_max_words: int = 15
    heading_max_symbols: float = 0.2
    content_min_words: int = 40
    content_max_words: int = 800
    content_min_alpha: float = 0.7
    content_min_punctuation: float = 0.01
    content_max_newlines: float = 0.2
    semantic_min: float = 0.25
    bad_headings: tuple[str, ...] = (r"^\d+$",)
    weights: tuple[float, float, float] = (0.3, 0.4, 0.3)
    flag_below: float = 70.0
    suspicious_below: float = 60.0


@dataclass(frozen=True)
class Repair:
    min_frequency: float = 0.05
    fuzzy: float = 90.0
    max_heading_words: int = 15
    small_words: int = 100
    seeds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Search:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    alpha: float = 0.6
    rrf_k: int = 60
    top_k: int = 20
    rerank: int = 10
    dim: int = 512
    parent_chars: int = 800
    budget_chars: int = 8500


@dataclass(frozen=True)
class Config:
    cleaning: Cleaning = field(default_factory=Cleaning)
    headings: Headings = field(default_factory=Headings)
    chunking: Chunking = field(default_factory=Chunking)
    validation: Validation = field(default_factory=Validation)
    repair: Repair = field(default_factory=Repair)
    search: Search = field(default_factory=Search)

    @classmethod
    def of(cls, values: dict) -> Config:
        """The defaults with the given values, by section and name; lists become tuples, unknown names are errors."""
        known = {f.name: f for f in fields(cls)}
        if unknown := set(values) - set(known):
            raise ValueError(f"no such sections: {sorted(unknown)}")
        parts = {}
        for name, given in values.items():
            part = getattr(cls(), name)
            if unknown := set(given or {}) - {f.name for f in fields(part)}:
                raise ValueError(f"no such values in {name}: {sorted(unknown)}")
            parts[name] = replace(part, **{k: tuple(v) if isinstance(v, list) else v for k, v in (given or {}).items()})
        return cls(**parts)

    @classmethod
    def load(cls, path: str) -> Config:
        """From a YAML or JSON file that the driver can open; YAML needs its library."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            return cls.of(json.loads(text))
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML files need the yaml library; JSON files don't") from e
        return cls.of(yaml.safe_load(text) or {})
