"""Terms as numbers: counts, TF-IDF, class TF-IDF, hashed embeddings, projection."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions import text as T
from corpusmith.session import spread

_TERM = re.compile(r"\w{2,}")  # letters, digits and underscores, as the column pattern of words


def term_frequencies(df: DataFrame, id_col: str, text: str, pattern: str = T.WORD) -> DataFrame:
    """(id, term, tf)."""
    some = spread(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t")))
    tokens = some.select("id", F.explode(T.words(F.col("t"), pattern)).alias("term"))
    return tokens.groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, max_features: int = 1000, min_df: int = 1, max_df_share: float = 1.0, n_docs: int | None = None) -> DataFrame:
    """(term, idx, ctf, df): the most frequent terms of the corpus, ties by term, numbered in alphabetical order.

    At most ``max_features`` rows, so it may be broadcast.
    """
    per = tf.groupBy("term").agg(F.sum("tf").alias("ctf"), F.count("*").alias("df")).where(F.col("df") >= min_df)
    if max_df_share < 1.0:
        per = per.where(F.col("df") <= max_df_share * F.lit(n_docs if n_docs is not None else tf.select("id").distinct().count()))
    per = per.orderBy(F.desc("ctf"), "term").limit(max_features)
    return per.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1).select("term", "idx", "ctf", "df")


def with_idf(vocab: DataFrame, n_docs: int) -> DataFrame:
    """Smoothed inverse document frequency: ln((1 + n) / (1 + df)) + 1."""
    return vocab.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def tfidf(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, term, idx, tf, weight): rows of length one over a fitted vocabulary with idf."""
    joined = tf.join(F.broadcast(vocab.select("term", "idx", "idf")), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return joined.select("id", "term", "idx", "tf", (F.col("raw") / length).alias("weight"))


def fit_tfidf(df: DataFrame, id_col: str, text: str, max_features: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(weights, vocabulary with idf) of a corpus."""
    vocab = fit_vocabulary(df, id_col, text, max_features)
    return tfidf(term_frequencies(df, id_col, text), vocab), vocab


def term_statistics(df: DataFrame, text: str, flush: int = 200_000) -> DataFrame:
    """(term, ctf, df) of a corpus: counted in the workers over whole batches, then added up by term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            terms = list(total)
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([total[t] for t in terms], pa.int64()), pa.array([held[t] for t in terms], pa.int64())], ["term", "ctf", "df"])

        for b in batches:
            for t in b.column(0).to_pylist():
                own = _TERM.findall(t.lower()) if t else ()
                total.update(own)
                held.update(set(own))
            if len(total) > flush:
                yield rows()
                total.clear()
                held.clear()
        yield rows()

    return spread(df.select(F.col(text).alias("t"))).mapInArrow(count, "term string, ctf bigint, df bigint").groupBy("term").agg(F.sum("ctf").alias("ctf"), F.sum("df").alias("df"))


def fit_vocabulary(df: DataFrame, id_col: str, text: str, max_features: int = 1000) -> DataFrame:
    """(term, idx, ctf, df, idf): the most frequent terms as ``vocabulary`` picks and numbers them, at most ``max_features`` rows."""
    some = df.where(F.col(id_col).isNotNull())
    n = some.count()
    best = term_statistics(some, text).orderBy(F.desc("ctf"), "term").limit(max_features).collect()
    rows = [(r.term, i, r.ctf, r.df, float(np.log((1.0 + n) / (1.0 + r.df)) + 1.0)) for i, r in enumerate(sorted(best, key=lambda r: r.term))]
    return df.sparkSession.createDataFrame(rows, "term string, idx int, ctf bigint, df bigint, idf double")


def sparse_rows(df: DataFrame, id_col: str, text: str, vocab: DataFrame, counts: bool = False) -> DataFrame:
    """(id, idx, w): each text's TF-IDF row of length one over a fitted vocabulary (or its plain counts), in one pass over the text.

    Term numbers as packed int32, ascending, and weights as packed float32. Texts without a known term have no row. The vocabulary is
    bounded by its ``max_features`` and sent to the workers.
    """
    given = df.sparkSession.sparkContext.broadcast({r.term: (r.idx, r.idf) for r in vocab.select("term", "idx", "idf").collect()})
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for t, (i, _) in given.value.items()}
        idf = np.zeros(max(number.values(), default=-1) + 1)
        for i, x in given.value.values():
            idf[i] = x
        for b in batches:
            held, at, w = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = [number[x] for x in _TERM.findall(t.lower()) if x in number] if t else None
                if own:
                    tf = np.bincount(own, minlength=len(idf))
                    terms = np.flatnonzero(tf)
                    weight = tf[terms].astype(np.float64) if counts else tf[terms] * idf[terms]
                    held.append(i)
                    at.append(terms.astype(np.int32).tobytes())
                    w.append((weight if counts else weight / np.linalg.norm(weight)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(held, pa.int64())), pa.array(at, pa.binary()), pa.array(w, pa.binary())], ["id", "idx", "w"])

    return spread(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"))).mapInArrow(run, f"id {kind}, idx binary, w binary")


def class_tfidf(df: DataFrame, topic: str, text: str, reduce_frequent: bool = False, bm25: bool = False) -> DataFrame:
    """(topic, term, weight): share of the term in the topic times ln(1 + A / corpus count), A the mean words a topic."""
    tokens = df.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), F.explode(T.words(F.col(text))).alias("term"))
    cells = tokens.groupBy("topic", "term").agg(F.count("*").alias("tf"))
    sizes = cells.groupBy("topic").agg(F.sum("tf").alias("size"))
    mean = sizes.agg(F.avg("size").alias("a"))
    totals = cells.groupBy("term").agg(F.sum("tf").alias("f"))
    joined = cells.join(sizes, "topic").join(totals, "term").crossJoin(F.broadcast(mean))
    share = F.col("tf") / F.col("size")
    if reduce_frequent:
        share = F.sqrt(share)
    idf = F.log(1 + (F.col("a") - F.col("f") + 0.5) / (F.col("f") + 0.5)) if bm25 else F.log(1 + F.col("a") / F.col("f"))
    return joined.select("topic", "term", (share * idf).alias("weight"))


def top_terms(weights: DataFrame, n: int = 20, digits: int = 6) -> DataFrame:
    """(topic, term, weight, rank): ranked on the rounded weight, ties by term."""
    rounded = weights.withColumn("weight", F.round("weight", digits))
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= n)


def topic_label(top: DataFrame, words: int = 4) -> DataFrame:
    """(topic, name): ``First: second, third, fourth``."""
    lists = top.where(F.col("rank") <= words).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("w"))
    rest = F.array_join(F.slice("w", 2, words - 1), ", ")
    return lists.select("topic", F.when(F.size("w") > 1, F.concat(F.initcap(F.col("w")[0]), F.lit(": "), rest)).otherwise(F.initcap(F.col("w")[0])).alias("name"))


Encoder = Callable[[pd.Series], np.ndarray]


def hashed_encoder(dim: int = 64, seed: int = 13) -> Encoder:
    """An encoder that needs no model: words hashed to signed random directions, log-weighted, of length one."""
    import zlib

    pattern, known, table = re.compile(r"\w{2,}"), {}, []

    def number(word: str) -> int:
        at = known.get(word)
        if at is None:
            if len(known) > 500_000:
                known.clear()
                table.clear()
            at = known[word] = len(table)
            table.append(np.random.default_rng([seed, zlib.crc32(word.encode())]).standard_normal(dim, np.float32))
        return at

    def encode(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            counts = Counter(pattern.findall((text or "").lower()))
            if counts:
                rows = np.stack([table[number(w)] for w in counts])
                out[i] = np.log1p(np.fromiter(counts.values(), np.float32, len(counts))) @ rows
                length = np.linalg.norm(out[i])
                if length:
                    out[i] /= length
        return out

    return encode


def embed(df: DataFrame, id_col: str, text: str, encoder: Encoder | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, embedding, *keep): Arrow batches through an encoder of texts; null texts embed as empty ones."""
    encode = encoder or hashed_encoder()
    shape = ", ".join([f"id {df.schema[id_col].dataType.simpleString()}", "embedding array<float>", *(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "embedding": list(np.asarray(encode(b["t"].fillna("")), np.float32)), **{c: b[c] for c in keep}})

    return spread(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), *keep)).mapInPandas(run, shape).withColumnRenamed("id", id_col)


def to_half(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, half): vectors as packed half-precision numbers, two bytes an entry; null vectors stay null."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "half": [None if v is None else np.asarray(v, np.float16).tobytes() for v in b["v"]]})

    return df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<float>").alias("v")).mapInPandas(run, f"id {kind}, half binary").withColumnRenamed("id", id_col)


def from_half(df: DataFrame, id_col: str, half: str) -> DataFrame:
    """(id, embedding): the vectors back from ``to_half``."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "embedding": [None if v is None else np.frombuffer(v, np.float16).astype(np.float32) for v in b["h"]]})

    return df.select(F.col(id_col).alias("id"), F.col(half).alias("h")).mapInPandas(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)


def embed_cached(df: DataFrame, id_col: str, text: str, path: str, encoder: Encoder | None = None, version: str = "hashed-64") -> DataFrame:
    """Embeddings by text, kept as a table keyed by (md5 of the text, encoder version): only new texts are encoded."""
    spark = df.sparkSession
    keyed = df.select(id_col, F.col(text).alias("t"), F.md5(F.coalesce(text, F.lit(""))).alias("key"))
    try:
        held = spark.read.parquet(path).where(F.col("version") == version)
        missing = keyed.select("key", "t").dropDuplicates(["key"]).join(held.select("key"), "key", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        missing = keyed.select("key", "t").dropDuplicates(["key"])
    embed(missing, "key", "t", encoder).withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    held = spark.read.parquet(path).where(F.col("version") == version).dropDuplicates(["key"])
    return keyed.join(held, "key").select(id_col, "embedding")


def cache_info(df_path: str, spark) -> dict[str, int]:
    held = spark.read.parquet(df_path)
    return {"entries": held.count(), "versions": held.select("version").distinct().count()}


def project(df: DataFrame, id_col: str, vec: str, k: int = 2) -> DataFrame:
    """(id, x1..xk): principal components of centred vectors; each component's largest loading is positive."""
    vectors = df.select(F.col(id_col).alias("id"), array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    mean = vectors.select(Summarizer.mean(F.col("v")).alias("m")).first()
    if mean is None or mean.m is None:
        return df.sparkSession.createDataFrame([], f"{id_col} string, " + ", ".join(f"x{i + 1} double" for i in range(k)))
    centre = F.array(*[F.lit(float(x)) for x in mean.m])
    centred = df.select(F.col(id_col).alias("id"), array_to_vector(F.zip_with(F.col(vec).cast("array<double>"), centre, lambda a, b: a - b)).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    out = model.transform(centred).select("id", vector_to_array("p").alias("p"))
    return out.select(F.col("id").alias(id_col), *[(F.col("p")[j] * signs[j]).alias(f"x{j + 1}") for j in range(k)])


