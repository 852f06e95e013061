"""Topics and models against each other: overlap, correlation, confusion, prevalence, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions import vectors as V


def jaccard(top: DataFrame, n: int = 10) -> DataFrame:
    """(topic_a, topic_b, similarity) of all pairs a < b by their first ``n`` words; pairs without a shared word 0.

    Topics are a model's, so the grid of pairs is as small as the model.
    """
    words = top.where(F.col("rank") <= n).select("topic", "term").distinct()
    sizes = words.groupBy("topic").agg(F.count("*").alias("n"))
    shared = words.select(F.col("topic").alias("a"), "term").join(words.select(F.col("topic").alias("b"), "term"), "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    grid = sizes.select(F.col("topic").alias("a"), F.col("n").alias("na")).join(sizes.select(F.col("topic").alias("b"), F.col("n").alias("nb")), F.expr("a < b"))
    full = grid.join(shared, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return full.select(F.col("a").alias("topic_a"), F.col("b").alias("topic_b"), F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("similarity"))


def edges(similar: DataFrame, least: float = 0.1) -> DataFrame:
    return similar.where(F.col("similarity") > least)


def landscape_size(count: str = "count"):
    """Marker sizes: 15 plus a fifth of the documents, at most 35 more."""
    return 15.0 + F.least(F.lit(35.0), F.col(count) / 5.0)


def word_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """(topic_a, topic_b, similarity): each topic of a with its nearest of b by cosine of word weights aligned by term."""
    length = lambda t: t.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("len"))
    dot = a.select(F.col("topic").alias("topic_a"), "term", F.col("weight").alias("wa")).join(b.select(F.col("topic").alias("topic_b"), "term", F.col("weight").alias("wb")), "term").groupBy("topic_a", "topic_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    scored = dot.join(length(a).select(F.col("topic").alias("topic_a"), F.col("len").alias("la")), "topic_a").join(length(b).select(F.col("topic").alias("topic_b"), F.col("len").alias("lb")), "topic_b")
    scored = scored.select("topic_a", "topic_b", F.round(F.col("dot") / (F.col("la") * F.col("lb")), 6).alias("similarity"))
    best = Window.partitionBy("topic_a").orderBy(F.desc("similarity"), "topic_b")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def word_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(topic, shared, only_a, only_b) of the topics that both have, as sorted arrays."""
    pack = lambda t, name: t.groupBy("topic").agg(F.array_sort(F.collect_set("term")).alias(name))
    both = pack(a, "wa").join(pack(b, "wb"), "topic")
    return both.select("topic", F.array_sort(F.array_intersect("wa", "wb")).alias("shared"), F.array_sort(F.array_except("wa", "wb")).alias("only_a"), F.array_sort(F.array_except("wb", "wa")).alias("only_b"))


def similar_topics(top: DataFrame, n: int = 3) -> DataFrame:
    """(topic, other, similarity, rank): the most alike other topics by term-aligned cosine."""
    length = top.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("len"))
    dot = top.select("topic", "term", F.col("weight").alias("wa")).join(top.select(F.col("topic").alias("other"), "term", F.col("weight").alias("wb")), "term").where("topic <> other").groupBy("topic", "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    scored = dot.join(length, "topic").join(length.select(F.col("topic").alias("other"), F.col("len").alias("lo")), "other").select("topic", "other", F.round(F.col("dot") / (F.col("len") * F.col("lo")), 6).alias("similarity"))
    best = Window.partitionBy("topic").orderBy(F.desc("similarity"), "other")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def correlation(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """(a, b, r): Pearson correlation of all pairs of columns; 0 where one is constant."""
    parts = [F.round(F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)), digits).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    one = df.agg(*parts)
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}_{j}").alias("r")) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def prevalence(scores: DataFrame, model: str) -> DataFrame:
    """(model, topic, mean) of long topic weights."""
    return scores.groupBy("topic").agg(F.avg("score").alias("mean")).select(F.lit(model).alias("model"), "topic", "mean")


def nearest_topics(a: DataFrame, b: DataFrame, name: str, vec: str, least: float = 0.7) -> DataFrame:
    """(topic_a, topic_b, similarity): nearest topic of another model by cosine, if above ``least``. Topics of two models are few."""
    pairs = a.select(F.col(name).alias("topic_a"), F.col(vec).alias("va")).crossJoin(b.select(F.col(name).alias("topic_b"), F.col(vec).alias("vb")))
    scored = pairs.select("topic_a", "topic_b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))
    best = Window.partitionBy("topic_a").orderBy(F.desc("similarity"), "topic_b")
    return scored.withColumn("r", F.row_number().over(best)).where((F.col("r") == 1) & (F.col("similarity") > least)).drop("r")


def search(df: DataFrame, id_col: str, vec: str, query: list[float], n: int = 10, digits: int = 9) -> DataFrame:
    """(id, score): the documents nearest a query vector; one pass and a bounded heap a partition."""
    length = sum(x * x for x in query) ** 0.5 or 1.0
    score = F.when(V.norm(F.col(vec)) > 0, V.dot_literal(F.col(vec), [x / length for x in query]) / V.norm(F.col(vec))).otherwise(0.0)
    return df.select(id_col, F.round(score, digits).alias("score")).orderBy(F.desc("score"), id_col).limit(n)
