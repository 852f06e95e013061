"""The staged workflow: every stage a new lazy table, only fits and reports run jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.config import Config
from corpusmith.functions import text as T
from corpusmith.operators import matching, models, prepare, series, vectorize
from corpusmith.sources import writers
from corpusmith.sources.readers import CorpusSpec, load


@dataclass(frozen=True)
class Workflow:
    """load → expand acronyms → correct spelling → preprocess → discover or match → report."""

    documents: DataFrame
    spec: CorpusSpec
    config: Config = Config()
    model: models.TopicModel | None = None
    told: Callable[[str, DataFrame], None] | None = None

    @classmethod
    def start(cls, data: str | DataFrame, text: str = "text", id: str = "doc_id", time: str | None = None, geo: str | None = None, category: str | None = None, config: Config | None = None, spark=None, told: Callable[[str, DataFrame], None] | None = None) -> Workflow:
        """``told`` is called with the name and the table of every stage that ran."""
        spec = CorpusSpec(text, id, time, geo, category)
        return cls(load(data, spec, spark), spec, config or Config(), told=told)

    def _next(self, stage: str, documents: DataFrame, **changes) -> Workflow:
        if self.told is not None:
            self.told(stage, documents)
        return replace(self, documents=documents, **changes)

    def expand_acronyms(self, mapping: dict[str, str] | None = None) -> Workflow:
        mapping = mapping if mapping is not None else dict(self.config.acronyms.mappings)
        return self if not mapping else self._next("expand_acronyms", prepare.expand_texts(self.documents, self.spec.text, mapping))

    def correct_spelling(self, corrections: dict[str, str] | None = None) -> Workflow:
        corrections = corrections if corrections is not None else dict(self.config.spelling.corrections)
        s = self.config.spelling
        return self if not corrections else self._next("correct_spelling", self.documents.withColumn(self.spec.text, prepare.correct_text(F.col(self.spec.text), corrections, min_length=s.min_word_length, max_distance=s.max_distance, min_score=s.min_score)))

    def preprocess(self, **flags: bool) -> Workflow:
        n = self.config.normalization
        options = {"lowercase": n.lowercase, "remove_punctuation": n.remove_punctuation, "remove_numbers": n.remove_numbers, "lemmatize": n.lemmatize, "custom": n.custom_stop_words, "keep": n.keep_words} | flags
        return self._next("preprocess", self.documents.withColumn("processed_text", T.normalize(F.col(self.spec.text), **options)))

    def embed(self, encoder: vectorize.Encoder | None = None) -> DataFrame:
        return vectorize.embed(self.documents, self.spec.id, self.spec.text, encoder or vectorize.hashed_encoder(self.config.embeddings.dimension))

    def discover(self, method: str | None = None, num_topics: int | None = None, **options) -> Workflow:
        ready = self if "processed_text" in self.documents.columns else self.preprocess()
        model = models.discover(ready.documents, self.spec.id, "processed_text", method or self.config.workflow.method, num_topics or self.config.workflow.num_topics, **options)
        topics = model.assigned.select(F.col("id").alias(self.spec.id), F.when(F.col("topic_id") < 0, "Noise").otherwise(F.concat(F.lit("Topic_"), F.col("topic_id"))).alias("topic"), F.col("probability").alias("topic_probability"))
        return ready._next("discover", ready.documents.drop("topic", "topic_probability").join(topics, self.spec.id, "left"), model=model)

    def match(self, topics: dict[str, str], threshold: float | None = None, multiple: bool | None = None, encoder: vectorize.Encoder | None = None) -> DataFrame:
        """Documents against described topics: both go through the same encoder."""
        encode = encoder or vectorize.hashed_encoder(self.config.embeddings.dimension)
        spark = self.documents.sparkSession
        described = spark.createDataFrame([(k, f"{k}: {v}" if v else k) for k, v in topics.items()], "topic string, t string")
        given = matching.topic_list(vectorize.embed(described, "topic", "t", encode), "topic", "embedding")
        rows = self.embed(encode)
        m = self.config.matching
        limit = m.threshold if threshold is None else threshold
        return matching.match_many(rows, self.spec.id, "embedding", given, limit, m.max_topics_per_doc) if (m.assign_multiple if multiple is None else multiple) else matching.match_one(rows, self.spec.id, "embedding", given, limit)

    def trends(self, freq: str = "W", top: int = 10) -> DataFrame:
        return series.topic_periods(self.documents, self.spec.time, "topic", freq, top=top)

    def report(self, path: str | None = None, examples: int = 5) -> str:
        told = series.topic_report(self.documents, self.spec.id, self.spec.text, "topic", examples)
        words = None if self.model is None else self.model.words.withColumn("topic", F.concat(F.lit("Topic_"), F.col("topic")))
        return writers.html_report(told, words, prepare.corpus_statistics(self.documents, self.spec.text), path=path)

    def run(self, acronyms: dict[str, str] | None = None, corrections: dict[str, str] | None = None, method: str | None = None, num_topics: int | None = None) -> Workflow:
        return self.expand_acronyms(acronyms).correct_spelling(corrections).preprocess().discover(method, num_topics)
