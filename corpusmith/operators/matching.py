"""Documents against given topics: matching by cosine, classifiers, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions.vectors import mean_vectors

MAX_TOPICS = 2_000


def topic_list(topics: DataFrame, name: str, vec: str) -> list[tuple[str, list[float]]]:
    """The topics on the driver, by name; refused past ``MAX_TOPICS``."""
    rows = topics.orderBy(name).limit(MAX_TOPICS + 1).collect()
    if len(rows) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    return [(r[name], [float(x) for x in r[vec]]) for r in rows]


def class_means(df: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, v): mean vector of each label; vectors are added up inside the batches first."""
    return mean_vectors(df.where(F.col(label).isNotNull()), label, vec).select(F.col("group").alias("label"), "v")


def similarities(df: DataFrame, id_col: str, vec: str, topics: list[tuple[str, list[float]]], digits: int = 9) -> DataFrame:
    """(id, topic, score) of every document and topic, without a shuffle: one matrix product a batch with the topics' vectors.

    A vector without length scores 0; null vectors are left out.
    """
    matrix = np.array([v for _, v in topics], np.float64).reshape(len(topics), -1)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    given = df.sparkSession.sparkContext.broadcast((np.array([n for n, _ in topics], object), matrix))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, m = given.value
        for whole in batches:
            for s in range(0, len(whole), 2048):
                b = whole.iloc[s : s + 2048]
                x = np.stack(b["v"].to_numpy())
                score = x @ m.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), len(names)), "topic": np.tile(names, len(b)), "score": score.ravel()})

    some = df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    return some.mapInPandas(run, f"id {kind}, topic string, score double").withColumn("score", F.round("score", digits))


def or_unknown(score: Column, topic: Column, threshold: float) -> Column:
    return F.when(score >= threshold, topic).otherwise("Unknown")


def best_topics(df: DataFrame, id_col: str, vec: str, topics: list[tuple[str, list[float]]], at_most: int, digits: int = 9) -> DataFrame:
    """(id, topics, scores): the ``at_most`` best topics of each document, best first, equal scores by falling name; found inside the batch."""
    ordered = sorted(topics, reverse=True)
    matrix = np.array([v for _, v in ordered], np.float64).reshape(len(ordered), -1)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    given = df.sparkSession.sparkContext.broadcast((np.array([n for n, _ in ordered], object), matrix))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, m = given.value
        for whole in batches:
            for s in range(0, len(whole), 2048):
                b = whole.iloc[s : s + 2048]
                x = np.stack(b["v"].to_numpy())
                score = np.round(x @ m.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), digits)
                order = np.argsort(-score, axis=1, kind="stable")[:, :at_most]
                yield pd.DataFrame({"id": b["id"].to_numpy(), "topics": list(names[order]), "scores": list(np.take_along_axis(score, order, 1))})

    some = df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    return some.mapInPandas(run, f"id {kind}, topics array<string>, scores array<double>")


def match_one(df: DataFrame, id_col: str, vec: str, topics: list[tuple[str, list[float]]], threshold: float = 0.6, digits: int = 9) -> DataFrame:
    """(id, primary_topic, topic_probability): the best topic, ``Unknown`` below the threshold; the score is always the best one."""
    best = best_topics(df, id_col, vec, topics, 1, digits)
    return best.select("id", or_unknown(F.col("scores")[0], F.col("topics")[0], threshold).alias("primary_topic"), F.col("scores")[0].alias("topic_probability"))


def match_many(df: DataFrame, id_col: str, vec: str, topics: list[tuple[str, list[float]]], threshold: float = 0.6, at_most: int = 3, digits: int = 9) -> DataFrame:
    """(id, all_topics, all_scores, primary_topic, topic_probability): topics at the threshold, best first; without any ``Unknown`` and 0."""
    best = best_topics(df, id_col, vec, topics, at_most, digits)
    held = F.size(F.filter("scores", lambda x: x >= threshold))  # the scores fall
    names = F.when(held == 0, F.array(F.lit("Unknown"))).otherwise(F.slice("topics", F.lit(1), held))
    values = F.when(held == 0, F.array(F.lit(0.0))).otherwise(F.slice("scores", F.lit(1), held))
    return best.select("id", names.alias("all_topics"), values.alias("all_scores"), names[0].alias("primary_topic"), values[0].alias("topic_probability"))


def wide(scores: DataFrame, topics: list[str]) -> DataFrame:
    """One similarity column a topic."""
    out = scores.groupBy("id").pivot("topic", topics).agg(F.first("score"))
    return out.select("id", *[F.col(f"`{t}`").alias(f"{t}_similarity") for t in topics])


CLASSIFIERS = {
    "logistic": lambda seed: LogisticRegression(maxIter=50, regParam=0.01),
    "random_forest": lambda seed: RandomForestClassifier(numTrees=50, seed=seed),
    "svm": lambda seed: OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01)),
    "xgboost": lambda seed: OneVsRest(classifier=GBTClassifier(maxIter=10, seed=seed)),
}


def fit_classifier(df: DataFrame, label: str, vec: str, kind: str = "logistic", seed: int = 42) -> PipelineModel:
    """A classifier of vectors; classes in alphabetical order."""
    if kind not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {kind}")
    data = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("name"), array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    index = StringIndexer(inputCol="name", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
    return Pipeline(stages=[index, CLASSIFIERS[kind](seed)]).fit(data)


def classify(model: PipelineModel, df: DataFrame, id_col: str, vec: str, threshold: float = 0.3, threshold_scale: float = 0.5) -> DataFrame:
    """(id, label, probability, probabilities): ``Unknown`` below ``threshold`` x ``threshold_scale``. Margins become shares by softmax."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    data = df.select(F.col(id_col).alias("id"), array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    scored = model.stages[1].transform(data)
    if "probability" in scored.columns:
        probs = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        e = F.transform(raw, F.exp)
        probs = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    scored = scored.select("id", F.col("prediction").cast("int").alias("k"), probs.alias("probabilities"))
    p = F.element_at("probabilities", F.col("k") + 1)
    return scored.select(F.col("id").alias(id_col), or_unknown(p, F.element_at(names, F.col("k") + 1), threshold * threshold_scale).alias("label"), p.alias("probability"), "probabilities")


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """(actual, predicted, count, share): share of the row in percent."""
    cells = df.where(F.col(true).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(true).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("count"))
    return cells.withColumn("share", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("actual")), 6))


def evaluate(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row: accuracy and precision, recall and F1 weighted by the true classes; 0/0 counts as 0."""
    cells = confusion(df, true, predicted)
    rows = cells.groupBy(F.col("actual").alias("c")).agg(F.sum("count").alias("support"))
    columns = cells.groupBy(F.col("predicted").alias("c")).agg(F.sum("count").alias("said"))
    hits = cells.where("actual = predicted").select(F.col("actual").alias("c"), F.col("count").alias("hit"))
    per = rows.join(columns, "c", "left").join(hits, "c", "left").na.fill(0, ["said", "hit"])
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.col("hit") / F.col("support")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    n = F.sum("support")
    mean = lambda x: F.round(F.sum(x * F.col("support")) / n, 6)
    return per.agg(F.round(F.sum("hit") / n, 6).alias("accuracy"), mean(p).alias("precision"), mean(r).alias("recall"), mean(f1).alias("f1"))
