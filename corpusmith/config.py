"""Settings of the engine as frozen dataclasses, checked when made; YAML in and out where PyYAML is installed."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, not {value!r}")


@dataclass(frozen=True)
class Normalization:
    lowercase: bool = True
    remove_punctuation: bool = True
    remove_numbers: bool = False
    lemmatize: bool = True
    language: str = "en"
    custom_stop_words: tuple[str, ...] = ()
    keep_words: tuple[str, ...] = ()


@dataclass(frozen=True)
class Spelling:
    enabled: bool = True
    min_word_length: int = 4
    max_distance: int = 2
    min_score: int = 80
    corrections: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Acronyms:
    enabled: bool = True
    min_length: int = 2
    mappings: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Embeddings:
    encoder: str = "hashed"
    dimension: int = 64
    batch_size: int = 32
    precision: str = "float32"

    def __post_init__(self) -> None:
        _one_of("precision", self.precision, ("float32", "float16"))


@dataclass(frozen=True)
class Lda:
    num_topics: int = 10
    passes: int = 20
    iterations: int = 400
    alpha: str = "auto"
    eta: str = "auto"

    def __post_init__(self) -> None:
        _one_of("alpha", self.alpha, ("auto", "symmetric", "asymmetric"))
        _one_of("eta", self.eta, ("auto", "symmetric"))


@dataclass(frozen=True)
class Clustering:
    algorithm: str = "hdbscan"
    min_cluster_size: int = 15
    min_samples: int = 5
    cluster_selection_method: str = "eom"
    n_clusters: int = 10

    def __post_init__(self) -> None:
        _one_of("algorithm", self.algorithm, ("hdbscan", "kmeans", "agglomerative"))
        _one_of("cluster_selection_method", self.cluster_selection_method, ("eom", "leaf"))


@dataclass(frozen=True)
class Matching:
    threshold: float = 0.6
    assign_multiple: bool = False
    max_topics_per_doc: int = 3

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie in 0..1")


@dataclass(frozen=True)
class Reporting:
    max_examples_per_topic: int = 5
    max_samples_per_topic: int = 5
    formats: tuple[str, ...] = ("html", "csv")
    resample: str = "W"

    def __post_init__(self) -> None:
        for f in self.formats:
            _one_of("format", f, ("html", "csv", "json", "parquet", "excel"))
        _one_of("resample", self.resample, ("D", "W", "M", "Q", "Y"))


@dataclass(frozen=True)
class Workflow:
    method: str = "embedding_cluster"
    num_topics: int = 10

    def __post_init__(self) -> None:
        _one_of("method", self.method, ("embedding_cluster", "lda", "bertopic", "top2vec", "simple_kmeans", "tfidf", "nmf", "lsa"))


@dataclass(frozen=True)
class Config:
    normalization: Normalization = field(default_factory=Normalization)
    spelling: Spelling = field(default_factory=Spelling)
    acronyms: Acronyms = field(default_factory=Acronyms)
    embeddings: Embeddings = field(default_factory=Embeddings)
    lda: Lda = field(default_factory=Lda)
    clustering: Clustering = field(default_factory=Clustering)
    matching: Matching = field(default_factory=Matching)
    reporting: Reporting = field(default_factory=Reporting)
    workflow: Workflow = field(default_factory=Workflow)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        parts = {}
        for f in dataclasses.fields(cls):
            given = values.get(f.name, {})
            kind = f.default_factory
            unknown = set(given) - {x.name for x in dataclasses.fields(kind)}
            if unknown:
                raise ValueError(f"unknown settings in {f.name}: {sorted(unknown)}")
            parts[f.name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
        return cls(**parts)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)


def merge(base: dict, override: dict) -> dict:
    """Nested settings; the second wins value by value."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | None = None, overrides: dict | None = None) -> Config:
    """Settings from a YAML or JSON file over the defaults, then the overrides."""
    values: dict = {}
    if path:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            values = json.loads(text)
        else:
            import yaml

            values = yaml.safe_load(text) or {}
    return Config.from_dict(merge(values, overrides or {}))


def save(config: Config, path: str) -> None:
    values = json.loads(json.dumps(config.to_dict()))
    if path.endswith(".json"):
        Path(path).write_text(json.dumps(values, indent=2), encoding="utf-8")
    else:
        import yaml

        Path(path).write_text(yaml.safe_dump(values, sort_keys=False), encoding="utf-8")
