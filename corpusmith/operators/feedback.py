"""Review of topic assignments: which documents to look at, and what the feedback changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions import vectors as V

UNCERTAINTY = {"entropy": V.entropy, "margin": V.margin, "least_confidence": V.least_confidence}


def uncertain(df: DataFrame, id_col: str, probs: str, n: int, how: str = "entropy") -> DataFrame:
    """(id, uncertainty) of the ``n`` least certain documents; ties by id."""
    if how not in UNCERTAINTY:
        raise ValueError(f"unknown uncertainty {how}")
    scored = df.select(id_col, F.round(UNCERTAINTY[how](F.col(probs)), 9).alias("uncertainty"))
    return scored.orderBy(F.desc("uncertainty"), id_col).limit(n)


def diverse(df: DataFrame, id_col: str, vec: str, n: int, seed: int = 42) -> DataFrame:
    """(id): the document nearest each of ``n`` k-means centres."""
    from corpusmith.operators.models import kmeans_assign

    assigned, _ = kmeans_assign(df, id_col, vec, n, seed=seed)
    nearest = Window.partitionBy("topic_id").orderBy("distance", id_col)
    return assigned.withColumn("r", F.row_number().over(nearest)).where("r = 1").select(id_col)


def combined(df: DataFrame, id_col: str, probs: str, vec: str, n: int, ratio: float = 0.7) -> DataFrame:
    """(id, reason): a share of uncertain documents, the rest diverse among the others."""
    first = uncertain(df, id_col, probs, int(n * ratio)).select(id_col, F.lit("uncertain").alias("reason"))
    rest = df.join(first.select(id_col), id_col, "left_anti")
    return first.unionByName(diverse(rest, id_col, vec, n - int(n * ratio)).select(id_col, F.lit("diverse").alias("reason")))


def to_review(df: DataFrame, id_col: str, n: int, probs: str | None = None, vec: str | None = None, ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """(id, reason) of ``n`` documents to review: uncertain and diverse ones where both columns are given, uncertain ones with
    probabilities alone, diverse ones with vectors alone, else a random choice that is the same on every run."""
    if probs and vec:
        return combined(df, id_col, probs, vec, n, ratio)
    if probs:
        return uncertain(df, id_col, probs, n).select(id_col, F.lit("uncertain").alias("reason"))
    if vec:
        return diverse(df, id_col, vec, n, seed).select(id_col, F.lit("diverse").alias("reason"))
    return df.where(F.col(id_col).isNotNull()).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).select(id_col, F.lit("random").alias("reason")).limit(n)


def refit(df: DataFrame, topic: str, vec: str) -> DataFrame:
    """(group, n, v): the topics' vectors learnt again from the documents as they are labelled now."""
    return V.mean_vectors(df.where(F.col(topic).isNotNull()), topic, vec)


def label_issues(df: DataFrame, id_col: str, label: str, probs: str, classes: list[str]) -> DataFrame:
    """(id, given, suggested, self_confidence): confident learning.

    A class's threshold is the mean probability its own documents give it; a document whose best class above threshold
    isn't its label is an issue. Unknown labels are left out first. Least self-confident first by rank.
    """
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    known = df.where(F.col(label).isNotNull() & (index > 0)).withColumn("k", index.cast("int"))
    own = known.withColumn("self", F.element_at(probs, F.col("k")))
    thresholds = own.groupBy("k").agg(F.avg("self").alias("t"))
    table = thresholds.agg(F.map_from_entries(F.collect_list(F.struct("k", "t"))).alias("m"))  # one entry a class
    over = F.transform(F.col(probs), lambda p, i: F.struct(F.when(p >= F.coalesce(F.try_element_at(F.col("m"), i + 1), F.lit(2.0)), p).otherwise(-1.0).alias("p"), (-i).alias("i")))
    best = own.crossJoin(F.broadcast(table)).withColumn("best", F.array_max(over))
    issue = best.where((F.col("best.p") >= 0) & (-F.col("best.i") + 1 != F.col("k")))
    names = F.array(*[F.lit(c) for c in classes])
    return issue.select(id_col, F.col(label).alias("given"), F.element_at(names, (-F.col("best.i") + 1).cast("int")).alias("suggested"), F.col("self").alias("self_confidence"))


def latest(log: DataFrame, id_col: str, time: str, *cols: str) -> DataFrame:
    """Each document's last entry; equal times by the columns' values."""
    last = Window.partitionBy(id_col).orderBy(F.desc(time), *[F.desc_nulls_last(c) for c in cols])
    return log.where(F.col(id_col).isNotNull()).withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")


def apply_feedback(docs: DataFrame, id_col: str, topic: str, log: DataFrame, corrected: str, time: str) -> DataFrame:
    """The documents with ``current_topic``: the last correction, else the topic they had; and whether it changed."""
    new = latest(log, id_col, time, corrected).select(id_col, F.col(corrected).alias("_new"))
    both = docs.join(new, id_col, "left").withColumn("current_topic", F.coalesce("_new", F.col(topic)))
    return both.withColumn("changed", ~F.col("current_topic").eqNullSafe(F.col(topic))).drop("_new")


def summary(log: DataFrame, original: str, corrected: str) -> DataFrame:
    """One row: reviewed, changed, rate."""
    changed = F.count_if(F.col(corrected).isNotNull() & ~F.col(corrected).eqNullSafe(F.col(original)))
    return log.agg(F.count("*").alias("reviewed"), changed.alias("changed"), F.round(F.try_divide(changed, F.count("*")), 6).alias("rate"))


def transitions(log: DataFrame, original: str, corrected: str) -> DataFrame:
    """(original, corrected, count, share): changes only, share of all changes in percent."""
    some = log.where(F.col(original).isNotNull() & F.col(corrected).isNotNull() & (F.col(original) != F.col(corrected)))
    cells = some.groupBy(F.col(original).alias("original"), F.col(corrected).alias("corrected")).agg(F.count("*").alias("count"))
    return cells.withColumn("share", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))), 6))


def sessions(log: DataFrame, session: str, original: str, corrected: str, corpus_size: int) -> DataFrame:
    """(session, reviewed, changed, percent, running sums, percent of the corpus reviewed so far)."""
    changed = F.count_if(F.col(corrected).isNotNull() & ~F.col(corrected).eqNullSafe(F.col(original)))
    per = log.groupBy(F.col(session).alias("session")).agg(F.count("*").alias("reviewed"), changed.alias("changed"))
    so_far = Window.partitionBy(F.lit(0)).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    out = per.withColumn("percent", F.round(100.0 * F.col("changed") / F.col("reviewed"), 6)).withColumn("reviewed_so_far", F.sum("reviewed").over(so_far)).withColumn("changed_so_far", F.sum("changed").over(so_far))
    return out.withColumn("percent_of_corpus", F.round(100.0 * F.col("reviewed_so_far") / max(corpus_size, 1), 6))


def net_change(log: DataFrame, original: str, corrected: str) -> DataFrame:
    """(topic, lost, gained, net, rank): by size of the net change."""
    some = log.where(F.col(original).isNotNull() & F.col(corrected).isNotNull() & (F.col(original) != F.col(corrected)))
    moves = some.select(F.explode(F.array(F.struct(F.col(original).alias("topic"), F.lit(-1).alias("d")), F.struct(F.col(corrected).alias("topic"), F.lit(1).alias("d")))).alias("m")).select("m.*")
    per = moves.groupBy("topic").agg(F.count_if(F.col("d") < 0).alias("lost"), F.count_if(F.col("d") > 0).alias("gained"), F.sum("d").alias("net"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("net")), "topic")))


def before_after(df: DataFrame, before: str, after: str) -> DataFrame:
    """(topic, before, after, difference): sizes on both sides, missing ones 0."""
    a = df.where(F.col(before).isNotNull()).groupBy(F.col(before).alias("topic")).agg(F.count("*").alias("before"))
    b = df.where(F.col(after).isNotNull()).groupBy(F.col(after).alias("topic")).agg(F.count("*").alias("after"))
    both = a.join(b, "topic", "full_outer").na.fill(0, ["before", "after"])
    return both.withColumn("difference", F.col("after") - F.col("before"))
