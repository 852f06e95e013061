"""Preprocessing of a corpus: acronyms, spelling, contexts, normalised text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions import text as T
from corpusmith.session import spread


def acronym_counts(df: DataFrame, text: str, min_length: int = 2) -> DataFrame:
    """(acronym, count) over all texts."""
    return df.select(F.explode(T.acronyms(F.col(text), min_length)).alias("acronym")).groupBy("acronym").agg(F.count("*").alias("count"))


def detect_acronyms(df: DataFrame, text: str, known: DataFrame | None = None, min_length: int = 2, min_count: int = 2, limit: int | None = None, include_known: bool = False) -> DataFrame:
    """Frequent acronyms that no dictionary (``known``: term) holds, most frequent first; with ``include_known`` all, and whether one holds them."""
    found = acronym_counts(df, text, min_length).where(F.col("count") >= min_count)
    if known is not None:
        held = known.select(F.col("term").alias("acronym")).distinct()
        found = found.join(held.withColumn("known", F.lit(True)), "acronym", "left").na.fill(False, ["known"]) if include_known else found.join(held, "acronym", "left_anti")
    found = found.orderBy(F.desc("count"), "acronym")
    return found.limit(limit) if limit else found


def expand_acronyms(text: Column, expansions: dict[str, str], compat: bool = False) -> Column:
    """``A`` as ``A (Expansion)``: each whole-word occurrence once.

    ``compat`` repeats what a plain replace per match does: every match in order replaces all occurrences, inside other words too,
    so repeated acronyms nest.
    """
    mapping = T.literal_map({k: f"{k} ({v})" for k, v in expansions.items()})
    if not compat:
        return T.replace_tokens(text, mapping)
    return F.aggregate(T.acronyms(text), T.text_or_empty(text), lambda acc, a: F.when(F.map_contains_key(mapping, a), F.replace(acc, a, F.try_element_at(mapping, a))).otherwise(acc))


def expand_texts(df: DataFrame, text: str, expansions: dict[str, str], literals: int = 1000) -> DataFrame:
    """``df`` with the acronyms of its texts expanded as ``expand_acronyms`` does: a literal map of up to ``literals`` entries in the plan, more as a broadcast."""
    if len(expansions) <= literals:
        return df.withColumn(text, expand_acronyms(F.col(text), expansions))
    given = df.sparkSession.sparkContext.broadcast(dict(expansions))

    def expand(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token, known = re.compile(r"[\w&]+"), given.value
        for b in batches:
            yield b.map(lambda t: token.sub(lambda m: f"{m[0]} ({known[m[0]]})" if m[0] in known else m[0], t or ""))

    return df.withColumn(text, F.pandas_udf(expand, "string")(F.col(text)))


def suggest(words: DataFrame, word: str, known: DataFrame, key: str, value: str, min_score: float = 60.0, limit: int = 5) -> DataFrame:
    """(word, suggestion, value, score, rank): the nearest known keys of each word.

    A score needs lengths that lie near enough, since every missing letter costs an edit: words meet only keys of such lengths,
    in an equi-join on the length. Nothing is lost by it.
    """
    share = max(min_score, 1e-9) / 100
    asked = words.select(F.col(word).alias("word")).where(F.col(word).isNotNull()).distinct().withColumn("_n", F.length("word"))
    keys = known.where(F.col(key).isNotNull()).select(F.col(key).alias("suggestion"), F.col(value).alias("value"))
    longest = F.least(F.floor(F.length("suggestion") / share + 1e-9), F.lit(10_000)).cast("int")
    fits = keys.withColumn("_n", F.explode(F.sequence(F.ceil(F.length("suggestion") * share - 1e-9).cast("int"), longest)))
    scored = asked.join(fits, "_n").select("word", "suggestion", "value", T.similarity(F.col("word"), F.col("suggestion")).alias("score")).where(F.col("score") >= min_score)
    best = Window.partitionBy("word").orderBy(F.desc("score"), "suggestion")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def corrections_of(words: DataFrame, word: str, corrections: dict[str, str], min_length: int = 4, max_distance: int = 2, min_score: float = 80.0) -> DataFrame:
    """(word, correction): a dictionary hit, else the nearest right word within the distance, else the word itself.

    Worked out once a distinct word, with the dictionary as a literal.
    """
    distinct = words.select(F.col(word).alias("word")).distinct()
    return distinct.select("word", correct_word(F.col("word"), corrections, min_length, max_distance, min_score).alias("correction"))


def correct_word(word: Column, corrections: dict[str, str], min_length: int = 4, max_distance: int = 2, min_score: float = 80.0) -> Column:
    low = F.lower(word)
    hit = F.try_element_at(T.literal_map({k.lower(): v for k, v in corrections.items()}), low)
    right = sorted({v.lower() for v in corrections.values() if " " not in v})
    if not right:
        return F.coalesce(hit, word)
    # distances only where the lengths allow them, and once a candidate
    near = lambda c: F.when(F.abs(F.length(low) - F.length(c)) <= max_distance, F.levenshtein(low, c, max_distance)).otherwise(-1)
    measured = F.transform(F.array(*[F.lit(w) for w in right]), lambda c: F.struct(near(c).alias("d"), c.alias("w")))
    score = lambda x: F.round(100.0 * (1 - x["d"] / F.greatest(F.length(low), F.length(x["w"]), F.lit(1))), 4)
    nearest = F.array_max(F.transform(measured, lambda x: F.struct(F.when(x["d"] >= 0, score(x)).otherwise(-1.0).alias("s"), x["w"].alias("w"))))
    fuzzy = F.when((F.length(word) >= min_length) & ~low.isin(right) & (nearest["s"] >= min_score), nearest["w"])
    return F.coalesce(hit, fuzzy, word)


def correct_text(text: Column, corrections: dict[str, str], **limits: float) -> Column:
    """Each word by its correction; everything between words stays."""
    parts = F.regexp_extract_all(T.text_or_empty(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.when(w.rlike(r"^[\p{L}\p{N}_]"), correct_word(w, corrections, **limits)).otherwise(w)), "")


def correct_texts(df: DataFrame, text: str, corrections: dict[str, str], at_most: int = 500, **limits: float) -> DataFrame:
    """``df`` with the text corrected: each distinct word is looked at once, and the texts then only look up the words that change.

    The lookup is a literal of at most ``at_most`` words; beyond it every word is worked out in place, with the same result.
    """
    df, pattern = spread(df), F.lit(r"[\p{L}\p{N}_]+")
    words = df.select(F.explode(F.regexp_extract_all(F.lower(T.text_or_empty(F.col(text))), pattern, F.lit(0))).alias("word"))
    changed = corrections_of(words, "word", corrections, **limits).where("correction <> word").limit(at_most + 1).collect()
    if len(changed) > at_most:
        return df.withColumn(text, correct_text(F.col(text), corrections, **limits))
    known = T.literal_map({r.word: r.correction for r in changed})
    parts = F.regexp_extract_all(T.text_or_empty(F.col(text)), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    return df.withColumn(text, F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w)), ""))


def detect_misspellings(df: DataFrame, text: str, corrections: dict[str, str], min_count: int = 2, min_length: int = 4, limit: int | None = None) -> DataFrame:
    """(word, count, correction, ratio): frequent words that the corrections would change."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(T.text_or_empty(F.col(text))), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)
    found = counts.withColumn("correction", correct_word(F.col("word"), corrections, min_length)).where("correction <> word")
    found = found.withColumn("ratio", T.similarity(F.col("word"), F.col("correction"))).orderBy(F.desc("count"), "word")
    return found.limit(limit) if limit else found


def contexts(df: DataFrame, id_col: str, text: str, words: DataFrame, word: str, pattern: str = T.TOKEN, n: int = 3, width: int = 200, ignore_case: bool = False) -> DataFrame:
    """(word, id, context, rank): the first ``n`` texts by id that hold the word, cut at ``width`` characters.

    Text and words meet in an equi-join on tokens; the ids are ranked first and the texts fetched for the few winners.
    """
    body = F.lower(T.text_or_empty(F.col(text))) if ignore_case else T.text_or_empty(F.col(text))
    tokens = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))).alias("word"))
    first = Window.partitionBy("word").orderBy("id")
    hits = tokens.join(words.select(F.col(word).alias("word")).distinct(), "word", "left_semi").distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)
    return hits.join(df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).groupBy("id").agg(F.min("t").alias("t")), "id").select("word", F.col("id").alias(id_col), T.ellipsis(F.col("t"), width).alias("context"), "rank")


def word_frequencies(df: DataFrame, topic: str, text: str, longer_than: int = 3) -> DataFrame:
    """(topic, word, count) of the words between white space that are longer than some letters."""
    words = df.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), F.explode(F.split(F.lower(T.text_or_empty(F.col(text))), r"\s+")).alias("word"))
    return words.where(F.length("word") > longer_than).groupBy("topic", "word").agg(F.count("*").alias("count"))


def corpus_statistics(df: DataFrame, text: str) -> DataFrame:
    """One row: documents, documents with words, mean words and all words."""
    n = T.word_count(F.col(text)).alias("w")
    return df.select(n).agg(F.count("*").alias("documents"), F.count_if(F.col("w") > 0).alias("filled"), F.round(F.avg("w"), 4).alias("mean_words"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"))
