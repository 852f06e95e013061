"""Term dictionaries of a team: clean tables, merging, comparing, JSON in and out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_TERMS = 100_000

def clean_terms(terms: DataFrame, kind: str, key: str = "term", value: str = "replacement", kind_col: str = "kind") -> DataFrame:
    """(term, replacement) of one kind: trimmed, without empty entries; of clashing entries the last by replacement wins."""
    t, r = F.trim(key), F.trim(value)
    some = terms.where((F.col(kind_col) == kind) & t.isNotNull() & (t != "") & r.isNotNull() & (r != ""))
    return some.groupBy(t.alias("term")).agg(F.max(r).alias("replacement"))


def as_dict(terms: DataFrame) -> dict[str, str]:
    """A dictionary table on the driver; refused past ``MAX_TERMS`` entries."""
    rows = terms.limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms; join the table instead")
    return {r.term: r.replacement for r in rows}


def merge(*tables: DataFrame) -> DataFrame:
    """Later tables win."""
    every = None
    for i, t in enumerate(tables):
        one = t.select("term", "replacement", F.lit(i).alias("n"))
        every = one if every is None else every.unionByName(one)
    last = Window.partitionBy("term").orderBy(F.desc("n"), F.desc("replacement"))
    return every.withColumn("r", F.row_number().over(last)).where("r = 1").select("term", "replacement")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(term, state, in_a, in_b): only in one of them, different, or same."""
    both = a.select("term", F.col("replacement").alias("in_a")).join(b.select("term", F.col("replacement").alias("in_b")), "term", "full_outer")
    state = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(F.col("in_a") == F.col("in_b"), "same").otherwise("different")
    return both.select("term", state.alias("state"), "in_a", "in_b")


@dataclass
class TeamConfig:
    """A team's vocabulary on the driver, as kept in JSON files."""

    name: str = "team"
    acronyms: dict[str, str] = field(default_factory=dict)
    corrections: dict[str, str] = field(default_factory=dict)
    stop_words: list[str] = field(default_factory=list)
    domain_terms: dict[str, object] = field(default_factory=dict)

    def add_acronym(self, key: str, value: str) -> TeamConfig:
        return self.update(acronyms={key: value})

    def add_correction(self, key: str, value: str) -> TeamConfig:
        return self.update(corrections={key: value})

    def update(self, acronyms: dict[str, str] | None = None, corrections: dict[str, str] | None = None, stop_words: list[str] | None = None, replace: bool = False) -> TeamConfig:
        """A changed copy: given entries are added, or take the place of the old ones."""
        return TeamConfig(
            self.name,
            ({} if replace and acronyms is not None else dict(self.acronyms)) | (acronyms or {}),
            ({} if replace and corrections is not None else dict(self.corrections)) | (corrections or {}),
            sorted(set([] if replace and stop_words is not None else self.stop_words) | set(stop_words or [])),
            dict(self.domain_terms),
        )

    def merged(self, other: TeamConfig, name: str | None = None) -> TeamConfig:
        """The other's entries win."""
        out = self.update(other.acronyms, other.corrections, other.stop_words)
        out.name, out.domain_terms = name or self.name, self.domain_terms | other.domain_terms
        return out

    def stats(self) -> dict[str, int]:
        return {"acronyms": len(self.acronyms), "corrections": len(self.corrections), "stop_words": len(self.stop_words), "domain_terms": len(self.domain_terms)}

    def differences(self, other: TeamConfig) -> dict[str, dict[str, object]]:
        out = {}
        for part in ("acronyms", "corrections"):
            a, b = getattr(self, part), getattr(other, part)
            out[part] = {"only_here": {k: a[k] for k in a.keys() - b.keys()}, "only_there": {k: b[k] for k in b.keys() - a.keys()}, "different": {k: (a[k], b[k]) for k in a.keys() & b.keys() if a[k] != b[k]}}
        return out

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, v, "acronym") for k, v in self.acronyms.items()] + [(k, v, "correction") for k, v in self.corrections.items()] + [(w, None, "stop_word") for w in self.stop_words]
        return spark.createDataFrame(rows, "term string, replacement string, kind string")

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.__dict__, indent=2, ensure_ascii=False, sort_keys=True), encoding="utf-8")

    def export(self, path: str, part: str) -> None:
        Path(path).write_text(json.dumps(getattr(self, part), indent=2, ensure_ascii=False, sort_keys=True), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> TeamConfig:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(found, dict):
            raise ValueError(f"{path} holds no team configuration")
        return cls(**{k: v for k, v in found.items() if k in cls.__dataclass_fields__})
