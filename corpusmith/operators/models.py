"""Topic models: k-means, NMF, LSA, LDA, density and agglomerative clustering, compositions and search."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, KMeans, KMeansModel
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.functions import text as T
from corpusmith.functions import vectors as V
from corpusmith.operators import vectorize as Z
from corpusmith.session import materialise

DENSITY_LIMIT = 20_000


def _features(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).withColumn("features", array_to_vector("v"))


def relabel(assigned: DataFrame) -> DataFrame:
    """Topics renumbered by falling size, ties by smallest id, so that labels don't depend on the seeding."""
    sizes = assigned.groupBy("topic_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = sizes.withColumn("new", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "first")) - 1)
    return assigned.join(F.broadcast(order.select("topic_id", "new")), "topic_id").drop("topic_id").withColumnRenamed("new", "topic_id")


def kmeans_fit(df: DataFrame, id_col: str, vec: str, k: int, seed: int = 42, restarts: int = 1, max_iter: int = 20) -> KMeansModel:
    """The cheapest of some k-means fits."""
    data = _features(df, id_col, vec).select("features").persist()
    fits = [KMeans(k=k, seed=seed + i, maxIter=max_iter).fit(data) for i in range(restarts)]
    data.unpersist()
    return min(fits, key=lambda m: m.summary.trainingCost)


def kmeans_assign(df: DataFrame, id_col: str, vec: str, k: int, seed: int = 42, restarts: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((id, topic_id, distance, probability), centres): probability is 1 / (1 + distance) as a share over all centres."""
    model = kmeans_fit(df, id_col, vec, k, seed, restarts)
    centers = np.stack(model.clusterCenters())
    return assign_to_centers(df, id_col, vec, centers).withColumnRenamed("id", id_col), centers


def assign_to_centers(df: DataFrame, id_col: str, vec: str, centers: np.ndarray) -> DataFrame:
    """(id, topic_id, distance, probability) for given centres; the centres are as many as the model has topics."""
    given = df.sparkSession.sparkContext.broadcast(np.asarray(centers, np.float64))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = given.value
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0))
                p = 1 / (1 + d)
                p /= p.sum(1, keepdims=True)
                at = d.argmin(1)
                yield pd.DataFrame({"id": b["id"], "topic_id": at.astype(np.int32), "distance": d[np.arange(len(d)), at], "probability": p[np.arange(len(p)), at], "probabilities": list(p)})

    shape = f"id {kind}, topic_id int, distance double, probability double, probabilities array<double>"
    return _features(df, id_col, vec).select("id", "v").mapInPandas(run, shape)


def nearest_sums(df: DataFrame, vec: str, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((k, dim) sums, counts) of the vectors nearest each centre, added up inside the batches, then by centre."""
    given = df.sparkSession.sparkContext.broadcast(np.asarray(centers, np.float64))
    k, dim = centers.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, dim)), np.zeros(k)
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                at = _distances(x, given.value).argmin(1)
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=k)
        yield pd.DataFrame({"c": range(k), "s": list(total), "n": count})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": b["c"].iloc[:1], "s": [np.sum(np.stack(b["s"]), 0)], "n": [b["n"].sum()]})

    shape = "c int, s array<double>, n double"
    some = df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"))
    got = {r.c: r for r in some.mapInPandas(run, shape).groupBy("c").applyInPandas(add, shape).collect()}
    return np.array([got[i].s for i in range(k)]), np.array([got[i].n for i in range(k)])


def topic_terms(assigned: DataFrame, weights: DataFrame, n: int = 20) -> DataFrame:
    """(topic, term, weight, rank): summed term weights of each topic's documents."""
    summed = assigned.select("id", F.col("topic_id").alias("topic")).join(weights.select("id", "term", "weight"), "id").groupBy("topic", "term").agg(F.sum("weight").alias("weight"))
    return Z.top_terms(summed, n)


def topic_info(assigned: DataFrame, top: DataFrame) -> DataFrame:
    """(topic, name, size, count, words)."""
    sizes = assigned.groupBy(F.col("topic_id").alias("topic")).agg(F.count("*").alias("size"))
    lists = top.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("words"))
    return sizes.join(lists, "topic", "left").join(Z.topic_label(top), "topic", "left").select("topic", F.coalesce("name", F.concat(F.lit("Topic "), "topic")).alias("name"), "size", F.col("size").alias("count"), "words")


def document_info(docs: DataFrame, id_col: str, text: str, assigned: DataFrame, info: DataFrame) -> DataFrame:
    """(id, document, topic, name, weight)."""
    named = assigned.join(F.broadcast(info.select(F.col("topic").alias("topic_id"), "name")), "topic_id", "left")
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("document")).join(named, "id").select(F.col("id").alias(id_col), "document", F.col("topic_id").alias("topic"), "name", F.col("probability").alias("weight"))


def rank_weights(top: DataFrame) -> DataFrame:
    """Weights for models whose words have ranks only: 1.0, 0.95, ..."""
    return top.withColumn("weight", F.greatest(F.lit(0.0), 1.0 - 0.05 * (F.col("rank") - 1)))


@dataclass
class TopicModel:
    """A fitted model: assignments, the topics' words, and what scoring new documents needs."""

    method: str
    assigned: DataFrame  # id, topic_id, probability
    words: DataFrame  # topic, term, weight, rank
    centers: np.ndarray | None = None
    vocab: DataFrame | None = None
    components: np.ndarray | None = None
    extra: dict = field(default_factory=dict)

    def info(self) -> DataFrame:
        return topic_info(self.assigned, self.words)

    def topic(self, number: int) -> DataFrame:
        return self.words.where(F.col("topic") == number).orderBy("rank")

    def document_info(self, docs: DataFrame, id_col: str, text: str) -> DataFrame:
        return document_info(docs, id_col, text, self.assigned, self.info())

    def transform(self, docs: DataFrame, id_col: str, text: str | None = None, vec: str | None = None) -> DataFrame:
        """(id, topic_id, probability) of new documents."""
        if self.method in ("nmf", "lsa"):
            return _project_rows(Z.sparse_rows(docs, id_col, text, self.vocab), self.components, self.method == "nmf")
        if self.method in ("tfidf",):
            return assign_rows(Z.sparse_rows(docs, id_col, text, self.vocab), self.centers)
        if self.centers is None:
            raise ValueError(f"{self.method} can't score new documents")
        if vec is None:
            docs, vec = Z.embed(docs, id_col, text), "embedding"
        return assign_to_centers(docs, id_col, vec, self.centers)

    def perplexity(self, docs: DataFrame, id_col: str, text: str) -> float:
        """The upper bound of the log perplexity a word of documents under an LDA model; a pass over them, so not part of the fit."""
        if "lda" not in self.extra:
            raise ValueError(f"{self.method} has no perplexity")
        return float(self.extra["lda"].logPerplexity(self.extra["counter"].transform(_lda_words(docs, id_col, text))))

    def similar(self, query: list[float], n: int = 5) -> DataFrame:
        """(topic, score): topics by dot product of the query with the topic's centre."""
        scores = sorted(((float(np.dot(query, c)), i) for i, c in enumerate(self.centers)), key=lambda x: (-x[0], x[1]))[:n]
        return self.assigned.sparkSession.createDataFrame([(i, s) for s, i in scores], "topic int, score double")

    def save(self, path: str) -> None:
        """Tables as parquet, arrays as tables; no pickles."""
        spark = self.assigned.sparkSession
        self.assigned.write.mode("overwrite").parquet(f"{path}/assigned")
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        meta = [("method", self.method)]
        spark.createDataFrame(meta, "key string, value string").write.mode("overwrite").json(f"{path}/meta")
        for name in ("centers", "components"):
            m = getattr(self, name)
            if m is not None:
                spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "i int, v array<double>").write.mode("overwrite").parquet(f"{path}/{name}")
        if self.vocab is not None:
            self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")

    @classmethod
    def load(cls, spark, path: str) -> TopicModel:
        meta = {r.key: r.value for r in spark.read.json(f"{path}/meta").collect()}
        out = cls(meta["method"], spark.read.parquet(f"{path}/assigned"), spark.read.parquet(f"{path}/words"))
        for name in ("centers", "components"):
            try:
                rows = spark.read.parquet(f"{path}/{name}").orderBy("i").collect()
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            setattr(out, name, np.array([r.v for r in rows]))
        try:
            out.vocab = spark.read.parquet(f"{path}/vocab")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        return out


def fit_kmeans_embeddings(docs: DataFrame, id_col: str, text: str, vectors: DataFrame, vec: str, k: int = 10, max_features: int = 1000, seed: int = 42, restarts: int = 1) -> TopicModel:
    """K-means on embeddings; words by summed counts over a vocabulary of the corpus."""
    _, centers = kmeans_assign(vectors, id_col, vec, k, seed, restarts)
    raw = materialise(assign_to_centers(vectors, id_col, vec, centers).select("id", "topic_id", "probability"))
    order = new_numbers(raw)
    vocab = Z.fit_vocabulary(docs, id_col, text, max_features)
    total = topic_sums(Z.sparse_rows(docs, id_col, text, vocab, counts=True).join(raw.select("id", "topic_id"), "id"), len(centers), vocab.count())
    held = [i for i in range(len(centers)) if i in order]
    assigned = raw.withColumn("topic_id", renumbered(F.col("topic_id"), order))
    return TopicModel("simple_kmeans", assigned, _row_words(total[held], [order[i] for i in held], vocab), centers[sorted(order, key=order.get)])


def new_numbers(assigned: DataFrame) -> dict[int, int]:
    """New number of each topic by falling size, ties by smallest id; one row a topic."""
    sizes = assigned.groupBy("topic_id").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    return {r.topic_id: i for i, r in enumerate(sorted(sizes, key=lambda r: (-r.n, r.first)))}


def renumbered(topic, order: dict[int, int]):
    return F.create_map(*[F.lit(int(x)) for p in order.items() for x in p])[topic] if order else topic


def topic_sums(rows: DataFrame, k: int, v: int) -> np.ndarray:
    """(k, v) summed weights of the rows (topic_id, idx, w) of each topic: k x v numbers, first summed up by the partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, v))
        for b in batches:
            n, at, w = _flat(b)
            np.add.at(total, (np.repeat(b["topic_id"].to_numpy(), n), at), w)
        yield pd.DataFrame({"c": range(k), "s": list(total)})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": b["c"].iloc[:1], "s": [np.sum(np.stack(b["s"]), 0)]})

    got = {r.c: r.s for r in rows.select("topic_id", "idx", "w").mapInPandas(run, "c int, s array<double>").groupBy("c").applyInPandas(add, "c int, s array<double>").collect()}
    return np.array([got.get(i, np.zeros(v)) for i in range(k)]).reshape(k, v)


def _row_words(rows: np.ndarray, topics: list[int], vocab: DataFrame, n: int = 20) -> DataFrame:
    """(topic, term, weight, rank) of the largest entries of each topic's row, as ``top_terms`` ranks them; entries of 0 are left out."""
    names = {r.idx: r.term for r in vocab.select("idx", "term").collect()}  # the vocabulary is bounded by max_features
    out = []
    for topic, row in zip(topics, np.round(rows, 6), strict=True):
        best = sorted(np.flatnonzero(row > 0), key=lambda j: (-row[j], names[j]))[:n]
        out += [(int(topic), names[j], float(row[j]), r + 1) for r, j in enumerate(best)]
    return vocab.sparkSession.createDataFrame(out, "topic int, term string, weight double, rank int")


def _term_rows(docs: DataFrame, id_col: str, text: str, max_features: int) -> tuple[DataFrame, DataFrame, int]:
    """(kept sparse rows, vocabulary, its size) of a corpus: one pass for the vocabulary, one for the rows."""
    vocab = Z.fit_vocabulary(docs, id_col, text, max_features)
    return Z.sparse_rows(docs, id_col, text, vocab).persist(), vocab, vocab.count()


def fit_tfidf_kmeans(docs: DataFrame, id_col: str, text: str, k: int = 10, max_features: int = 1000, seed: int = 42) -> TopicModel:
    """K-means on TF-IDF rows; words by summed weights."""
    rows, vocab, size = _term_rows(docs, id_col, text, max_features)
    if not size:
        return TopicModel("tfidf", docs.sparkSession.createDataFrame([], "id string, topic_id int, probability double"), docs.sparkSession.createDataFrame([], "topic int, term string, weight double, rank int"))
    centers = sparse_kmeans(rows, size, k, seed)
    raw = materialise(assign_rows(rows, centers))
    total, _, _ = _center_sums(rows, centers)
    rows.unpersist()
    order = new_numbers(raw)
    held = sorted(order, key=order.get)
    return TopicModel("tfidf", raw.withColumn("topic_id", renumbered(F.col("topic_id"), order)), _row_words(total[held], list(range(len(held))), vocab), centers[held], vocab)


def sparse_kmeans(rows: DataFrame, size: int, k: int, seed: int = 42, iterations: int = 15, sample: int = 4096, tol: float = 1e-4) -> np.ndarray:
    """Centres of sparse rows: k-means++ and first steps over a sample of at most about ``sample`` rows, then distributed Lloyd steps.

    Rows are made dense a thousand at a time inside the workers; each step adds up k x V sums, first a partition at a time.
    """
    n = rows.count()
    share = min(1.0, sample / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_003)) < int(share * 1_000_003) + 1).orderBy("id").toPandas()
    x, rng = _dense(picked, size), np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    d = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < min(k, len(x)) and d.sum() > 0:
        at.append(int(rng.choice(len(x), p=d / d.sum())))
        d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(1))
    centers = x[at].copy()
    for _ in range(iterations):  # steps over the sample alone bring the centres near, so that few are left for all rows
        near = _distances(x, centers).argmin(1)
        one = np.zeros((len(centers), len(x)), np.float32)
        one[near, np.arange(len(x))] = 1
        held = one.any(1)
        moved = centers.copy()
        moved[held] = (one @ x)[held] / one.sum(1)[held, None]
        shift = float(((moved - centers) ** 2).sum())
        centers = moved
        if shift < tol:
            break
    previous = np.inf
    for _ in range(iterations):
        total, count, cost = _center_sums(rows, centers)
        held = count > 0
        centers[held] = total[held] / count[held, None]
        if previous - cost < tol * max(previous, 1e-12):
            break
        previous = cost
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def _center_sums(rows: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    given = rows.sparkSession.sparkContext.broadcast(centers.astype(np.float32))
    k, v = centers.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count, cost = np.zeros((k, v)), np.zeros(k), np.zeros(k)
        for whole in batches:
            for s in range(0, len(whole), 1024):
                x = _dense(whole.iloc[s : s + 1024], v)
                d = _distances(x, given.value)
                near = d.argmin(1)
                one = np.zeros((k, len(x)), np.float32)
                one[near, np.arange(len(x))] = 1
                total += one @ x
                count += one.sum(1)
                cost += one @ d.min(1)
        yield pd.DataFrame({"c": range(k), "s": list(total), "n": count, "cost": cost})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": b["c"].iloc[:1], "s": [np.sum(np.stack(b["s"]), 0)], "n": [b["n"].sum()], "cost": [b["cost"].sum()]})

    shape = "c int, s array<double>, n double, cost double"
    got = {r.c: r for r in rows.select("idx", "w").mapInPandas(run, shape).groupBy("c").applyInPandas(add, shape).collect()}
    return np.array([got[i].s for i in range(k)]), np.array([got[i].n for i in range(k)]), sum(r.cost for r in got.values())


def assign_rows(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, topic_id, probability) of sparse rows."""
    given = rows.sparkSession.sparkContext.broadcast(centers.astype(np.float32))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for s in range(0, len(whole), 1024):
                b = whole.iloc[s : s + 1024]
                d = np.sqrt(_distances(_dense(b, given.value.shape[1]), given.value))
                p = 1 / (1 + d)
                at = d.argmin(1)
                yield pd.DataFrame({"id": b["id"], "topic_id": at.astype(np.int32), "probability": (p[np.arange(len(p)), at] / p.sum(1)).astype(np.float64)})

    return rows.mapInPandas(run, f"id {kind}, topic_id int, probability double")


def fit_nmf(docs: DataFrame, id_col: str, text: str, k: int = 10, max_features: int = 1000, iterations: int = 15, seed: int = 42, tol: float = 1e-4) -> TopicModel:
    """Non-negative factors by alternating updates: rows stay distributed, the k x V factor is broadcast.

    Each pass solves every row for the given factor by multiplicative steps and adds up W'X (k x V) and W'W (k x k) from
    partial sums of the workers; the factor is updated on the driver, whose memory is k x V at most.
    """
    rows, vocab, v = _term_rows(docs, id_col, text, max_features)
    h = np.abs(np.random.default_rng(seed).standard_normal((k, v))) * 0.1 + 0.01
    previous = np.inf
    for _ in range(iterations):
        wx, ww, loss = _nmf_sums(rows, h)
        h *= wx / np.maximum(ww @ h, 1e-12)
        if previous - loss < tol * max(previous, 1e-12):
            break
        previous = loss
    model = TopicModel("nmf", None, None, vocab=vocab, components=h, extra={"loss": loss})
    assigned = materialise(_project_rows(rows, h, nmf=True))
    rows.unpersist()
    model.assigned, model.words = assigned, _component_words(h, vocab)
    return model


def _nmf_solve(x: np.ndarray, h: np.ndarray, steps: int = 12) -> np.ndarray:
    xh, hh = x @ h.T, h @ h.T
    w = np.full((len(x), len(h)), 0.1, x.dtype)
    for _ in range(steps):
        w *= xh / np.maximum(w @ hh, 1e-12)
    return w


def _flat(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each row, all term numbers, all weights) of packed rows."""
    n = np.fromiter((len(x) // 4 for x in b["idx"]), np.int64, len(b))
    return n, np.frombuffer(b"".join(b["idx"]), np.int32), np.frombuffer(b"".join(b["w"]), np.float32)


def _dense(b: pd.DataFrame, v: int) -> np.ndarray:
    x = np.zeros((len(b), v), np.float32)
    n, at, w = _flat(b)
    x[np.repeat(np.arange(len(b)), n), at] = w
    return x


def _nmf_sums(rows: DataFrame, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    given = rows.sparkSession.sparkContext.broadcast(h.astype(np.float32))
    k, v = h.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wx, ww, loss = np.zeros((k, v)), np.zeros((k, k)), 0.0
        for whole in batches:
            for s in range(0, len(whole), 1024):
                x = _dense(whole.iloc[s : s + 1024], v)
                w = _nmf_solve(x, given.value)
                wx += w.T @ x
                ww += w.T @ w
                loss += float(((x - w @ given.value) ** 2).sum())
        yield pd.DataFrame({"row": list(range(k)) + [-1], "wx": [*wx, np.zeros(0)], "ww": [*ww, np.zeros(0)], "loss": [0.0] * k + [loss]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": b["row"].iloc[:1], "wx": [np.sum(np.stack(b["wx"]), 0)], "ww": [np.sum(np.stack(b["ww"]), 0)], "loss": [b["loss"].sum()]})

    shape = "row int, wx array<double>, ww array<double>, loss double"
    got = {r.row: r for r in rows.mapInPandas(run, shape).groupBy("row").applyInPandas(add, shape).collect()}
    return np.array([got[i].wx for i in range(k)]), np.array([got[i].ww for i in range(k)]), got[-1].loss


def _project_rows(rows: DataFrame, h: np.ndarray, nmf: bool) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast(h.astype(np.float32))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for s in range(0, len(whole), 1024):
                b = whole.iloc[s : s + 1024]
                x = _dense(b, given.value.shape[1])
                w = _nmf_solve(x, given.value) if nmf else x @ given.value.T
                at = np.abs(w).argmax(1)
                total = np.maximum(np.abs(w).sum(1), 1e-12)
                yield pd.DataFrame({"id": b["id"], "topic_id": at.astype(np.int32), "probability": (np.abs(w)[np.arange(len(w)), at] / total).astype(np.float64), "weights": list(w.astype(np.float64))})

    return rows.mapInPandas(run, f"id {kind}, topic_id int, probability double, weights array<double>")


def _component_words(h: np.ndarray, vocab: DataFrame, n: int = 20) -> DataFrame:
    names = {r.idx: r.term for r in vocab.select("idx", "term").collect()}  # the vocabulary is bounded by max_features
    rows = []
    for i, row in enumerate(h):
        best = sorted(range(len(row)), key=lambda j: (-round(abs(float(row[j])), 6), names[j]))[:n]
        rows += [(i, names[j], float(row[j]), r + 1) for r, j in enumerate(best)]
    return vocab.sparkSession.createDataFrame(rows, "topic int, term string, weight double, rank int")


def fit_lsa(docs: DataFrame, id_col: str, text: str, k: int = 10, max_features: int = 1000, passes: int = 6, spare: int = 10, seed: int = 42) -> TopicModel:
    """Truncated singular value decomposition of TF-IDF rows by subspace iteration; each component's largest loading is positive.

    Each pass multiplies X'X with a narrow V x (k + spare) block, summed up by the workers; no V x V matrix is made.
    """
    rows, vocab, size = _term_rows(docs, id_col, text, max_features)
    width = min(k + spare, size)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for _ in range(passes):
        y = _gram_times(rows, q)
        values, turn = np.linalg.eigh(q.T @ y)
        q = np.linalg.qr(y)[0]
    y = _gram_times(rows, q)
    values, turn = np.linalg.eigh(q.T @ y)
    order = np.argsort(-values)[: min(k, size)]
    v = q @ turn[:, order]
    v *= np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    assigned = materialise(_project_rows(rows, v.T, nmf=False))
    rows.unpersist()
    return TopicModel("lsa", assigned, _component_words(v.T, vocab), vocab=vocab, components=v.T, extra={"singular_values": [float(x) for x in np.sqrt(np.maximum(values[order], 0))]})


def _gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """X'X q from partial sums, a few columns a reducer."""
    given = rows.sparkSession.sparkContext.broadcast(q.astype(np.float32))
    v, width = q.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, v))
        for whole in batches:
            for s in range(0, len(whole), 1024):
                x = _dense(whole.iloc[s : s + 1024], v)
                total += (x @ given.value).T @ x
        yield pd.DataFrame({"c": range(width), "s": list(total)})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": b["c"].iloc[:1], "s": [np.sum(np.stack(b["s"]), 0)]})

    got = {r.c: r.s for r in rows.select("idx", "w").mapInPandas(run, "c int, s array<double>").groupBy("c").applyInPandas(add, "c int, s array<double>").collect()}
    return np.array([got[i] for i in range(width)]).T


def _lda_words(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.filter(T.words(F.col(text)), lambda w: ~w.isin(T.STOP_WORDS)).alias("words"))


def fit_lda(docs: DataFrame, id_col: str, text: str, k: int = 10, iterations: int = 20, vocab_size: int = 5000, min_df: float = 2, max_df: float = 0.9, seed: int = 42) -> TopicModel:
    """Online variational LDA; (id, topic_id, probability, distribution) with the largest share first."""
    words = _lda_words(docs, id_col, text)
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocab_size, minDF=min_df, maxDF=max_df).fit(words)
    data = counter.transform(words).persist()
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online", optimizeDocConcentration=True).fit(data)
    spread = model.transform(data).select("id", vector_to_array("topicDistribution").alias("distribution"))
    best = F.array_max(F.transform("distribution", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    assigned = materialise(spread.select("id", (-best["i"]).cast("int").alias("topic_id"), best["p"].alias("probability"), "distribution"))
    data.unpersist()
    rows = [(r.topic, counter.vocabulary[t], float(w), i + 1) for r in model.describeTopics(20).collect() for i, (t, w) in enumerate(zip(r.termIndices, r.termWeights, strict=True))]
    return TopicModel("lda", assigned, docs.sparkSession.createDataFrame(rows, "topic int, term string, weight double, rank int"), extra={"lda": model, "counter": counter})


def topic_counts(assigned: DataFrame, spread: str, least: float = 0.2, compat: bool = False) -> DataFrame:
    """(topic, count): documents by their largest share, or (compat) by the first topic with a share of ``least``."""
    if compat:
        at = F.array_position(F.transform(spread, lambda p: p >= least), True) - 1
        return assigned.withColumn("topic", at).where("topic >= 0").groupBy("topic").agg(F.count("*").alias("count"))
    best = F.array_max(F.transform(spread, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    return assigned.withColumn("topic", -best["i"]).groupBy("topic").agg(F.count("*").alias("count"))


def ward(centers: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Ward merging of weighted points down to ``k`` groups; group numbers in the order of their first point.

    The costs of merging are updated in place and every row keeps its cheapest partner, so a merge costs time in proportion to the points.
    """
    x, n, count = np.asarray(centers, float), np.asarray(sizes, float).copy(), len(centers)
    if count <= k:
        return np.arange(count)
    sq = (x * x).sum(1)
    d = np.maximum(sq[:, None] - 2 * x @ x.T + sq, 0) * (n[:, None] * n / (n[:, None] + n))
    np.fill_diagonal(d, np.inf)
    near, group, live = d.argmin(1), np.arange(count), np.ones(count, bool)
    least = d[np.arange(count), near]
    for _ in range(count - k):
        i = int(np.where(live, least, np.inf).argmin())
        i, j = sorted((i, int(near[i])))
        new = ((n[i] + n) * d[i] + (n[j] + n) * d[j] - n * d[i, j]) / (n[i] + n[j] + n)
        new[[i, j]] = np.inf
        new[~live] = np.inf
        n[i] += n[j]
        live[j] = False
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        group[group == j] = i
        stale = np.flatnonzero(live & ((near == i) | (near == j) | (np.arange(count) == i)))
        near[stale] = d[stale].argmin(1)
        least[stale] = d[stale, near[stale]]
        closer = live & (new < least)
        near[closer], least[closer] = i, new[closer]
    return np.unique(group, return_inverse=True)[1]


def fit_agglomerative(vectors: DataFrame, id_col: str, vec: str, n_clusters: int, micro: int = 200, exact: int = 2000, seed: int = 42) -> DataFrame:
    """(id, topic_id, probability): Ward merging of up to ``exact`` vectors themselves, of more by the centres of many small k-means clusters.

    Beyond ``exact`` the hierarchy starts at ``micro`` (or twice ``n_clusters``) weighted centres: all pairs of all points have no bound.
    """
    few = _features(vectors, id_col, vec).select("id", "v").orderBy("id").limit(exact + 1).collect()
    if len(few) <= exact:
        kind = vectors.schema[id_col].dataType.simpleString()
        if not few:
            return vectors.sparkSession.createDataFrame([], f"id {kind}, topic_id int, probability double")
        group = ward(np.array([r.v for r in few]), np.ones(len(few)), n_clusters)
        return relabel(vectors.sparkSession.createDataFrame([(r.id, int(g), 1.0) for r, g in zip(few, group, strict=True)], f"id {kind}, topic_id int, probability double"))
    n = vectors.count()
    k = int(min(max(micro, 2 * n_clusters), max(n // 3, n_clusters)))
    fine, centers = kmeans_assign(vectors, id_col, vec, k, seed)
    fine = materialise(fine.withColumnRenamed(id_col, "id"))
    sizes = np.zeros(len(centers))
    for r in fine.groupBy("topic_id").count().collect():
        sizes[r.topic_id] = r["count"]
    held = np.flatnonzero(sizes)
    group = ward(centers[held], sizes[held], n_clusters)
    mapping = F.create_map(*[F.lit(int(x)) for i, g in zip(held, group, strict=True) for x in (i, g)])
    return relabel(fine.select("id", mapping[F.col("topic_id")].alias("topic_id"), F.lit(1.0).alias("probability")))


def condense(edges: list[tuple[float, int, int]], n: int, min_size: int, method: str = "eom") -> tuple[np.ndarray, np.ndarray]:
    """(labels, membership) from the spanning edges (distance, a, b) of ``n`` points: -1 is noise.

    The merge tree is cut into clusters of at least ``min_size`` points; by excess of mass, a cluster is kept if it is more
    stable than its kept parts together, or the leaves of the condensed tree are taken. The whole is never a cluster.
    """
    parent, node, left, height, size = list(range(n)), list(range(n)), {}, {}, [1] * n
    find = lambda i: i if parent[i] == i else find_up(i)

    def find_up(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    count = n
    for d, a, b in sorted(edges):
        ra, rb = find(a), find(b)
        if ra == rb:
            continue
        left[count], height[count] = (node[ra], node[rb]), d
        parent[rb] = ra
        node[ra] = count
        size.append(size[left[count][0]] + size[left[count][1]])
        count += 1
    if count < 2 * n - 1 or n < min_size:
        return np.full(n, -1), np.zeros(n)

    def points(t: int) -> list[int]:
        out, stack = [], [t]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += left[x]
        return out

    clusters = [{"birth": 0.0, "parent": -1, "stability": 0.0, "points": {}, "children": []}]
    stack = [(count - 1, 0)]
    while stack:
        t, c = stack.pop()
        if t < n:
            continue
        lam = 1.0 / max(height[t], 1e-12)
        a, b = left[t]
        big = [x for x in (a, b) if size[x] >= min_size]
        if len(big) == 2:
            for x in big:
                clusters.append({"birth": lam, "parent": c, "stability": 0.0, "points": {}, "children": []})
                clusters[c]["children"].append(len(clusters) - 1)
                clusters[c]["stability"] += (lam - clusters[c]["birth"]) * size[x]
                stack.append((x, len(clusters) - 1))
        else:
            for x in (a, b):
                if x in big:
                    stack.append((x, c))
                else:
                    for p in points(x):
                        clusters[c]["points"][p] = lam
                        clusters[c]["stability"] += lam - clusters[c]["birth"]
    chosen = set()
    if method == "leaf":
        chosen = {i for i, c in enumerate(clusters) if not c["children"] and i}
    else:
        value = [0.0] * len(clusters)
        for i in range(len(clusters) - 1, 0, -1):
            kids = sum(value[j] for j in clusters[i]["children"])
            if clusters[i]["stability"] >= kids:
                value[i] = clusters[i]["stability"]
                below = list(clusters[i]["children"])
                while below:
                    j = below.pop()
                    chosen.discard(j)
                    below += clusters[j]["children"]
                chosen.add(i)
            else:
                value[i] = kids
    labels, membership = np.full(n, -1), np.zeros(n)
    for label, i in enumerate(sorted(chosen)):
        own, below = dict(clusters[i]["points"]), list(clusters[i]["children"])
        while below:
            j = below.pop()
            own |= clusters[j]["points"]
            below += clusters[j]["children"]
        top = max(own.values(), default=1.0)
        for p, lam in own.items():
            labels[p], membership[p] = label, min(lam / top, 1.0)
    return labels, membership


def fit_density(vectors: DataFrame, id_col: str, vec: str, min_cluster_size: int = 15, min_samples: int = 5, method: str = "eom", limit: int = DENSITY_LIMIT) -> DataFrame:
    """(id, topic_id, probability): hierarchical density clusters; -1 is noise.

    Exact mutual-reachability distances at every size: the spanning tree of up to ``limit`` points is grown from one row of
    distances at a time, that of more by the workers, in rounds over leaves of nearby points. The driver holds the points'
    vectors, the tree and the labels.
    """
    rows = sorted(_features(vectors, id_col, vec).select("id", "v").collect(), key=lambda r: r.id)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not rows:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, topic_id int, probability double")
    x = np.array([r.v for r in rows], np.float64)
    edges = mutual_tree(x, min_samples) if len(x) <= limit else mutual_tree_by_leaves(vectors.sparkSession, x, min_samples)
    labels, membership = condense(edges, len(x), min_cluster_size, method)
    return vectors.sparkSession.createDataFrame([(r.id, int(a), float(p)) for r, a, p in zip(rows, labels, membership, strict=True)], f"id {kind}, topic_id int, probability double")


def mutual_tree(x: np.ndarray, min_samples: int) -> list[tuple[float, int, int]]:
    """Minimum spanning edges under mutual reachability, grown from point 0 with one row of distances at a time."""
    n, sq = len(x), (x * x).sum(1)
    core = np.empty(n)
    for s in range(0, n, 512):
        d = np.sqrt(np.maximum(sq[s : s + 512, None] - 2 * x[s : s + 512] @ x.T + sq, 0))
        core[s : s + 512] = np.partition(d, min(min_samples, n - 1), axis=1)[:, min(min_samples, n - 1)]
    done, best, source = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, np.int64)
    at, edges = 0, []
    for _ in range(n - 1):
        done[at] = True
        d = np.maximum(np.maximum(np.sqrt(np.maximum(sq[at] - 2 * x @ x[at] + sq, 0)), core[at]), core)
        closer = ~done & (d < best)
        best[closer], source[closer] = d[closer], at
        at = int(np.where(done, np.inf, best).argmin())
        edges.append((float(best[at]), int(source[at]), at))
    return edges


def _leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Numbers of points in leaves of at most ``most``, halved along their widest side."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        own = stack.pop()
        if len(own) <= most:
            out.append(own)
            continue
        side = int(np.ptp(x[own], axis=0).argmax())
        own = own[np.argsort(x[own, side], kind="stable")]
        stack += [own[: len(own) // 2], own[len(own) // 2 :]]
    return out


def mutual_tree_by_leaves(spark: SparkSession, x: np.ndarray, min_samples: int, most: int = 128) -> list[tuple[float, int, int]]:
    """The same edges by Boruvka rounds: every leaf finds the nearest point of another component for each of its components.

    A leaf looks at other leaves by rising distance of their boxes, as far as that can still matter. Equal distances are
    ordered by the points' numbers.
    """
    n, leaves = len(x), _leaves(x, most)
    low, high = np.array([x[o].min(0) for o in leaves]), np.array([x[o].max(0) for o in leaves])
    k, sc = min(min_samples, n - 1), spark.sparkContext
    given = sc.broadcast((x, leaves, low, high))
    parts = min(len(leaves), 8 * sc.defaultParallelism)

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = np.zeros((len(p), len(q)))
        for j in range(p.shape[1]):  # the same from both sides to the last bit
            d += (p[:, j, None] - q[None, :, j]) ** 2
        return np.sqrt(d)

    def ahead(a: int) -> tuple[np.ndarray, np.ndarray]:
        _, _, low, high = given.value
        gap = np.sqrt((np.maximum(np.maximum(low - high[a], low[a] - high), 0) ** 2).sum(1)) * (1 - 1e-12)
        order = np.argsort(gap, kind="stable")
        return order, gap[order]

    def cores(numbers: Iterator[int]) -> Iterator[tuple[int, np.ndarray]]:
        x, leaves, _, _ = given.value
        for a in numbers:
            near = np.full((len(leaves[a]), k + 1), np.inf)
            for b, gap in zip(*ahead(a), strict=True):
                if gap > near[:, k].max():
                    break
                near = np.sort(np.partition(np.hstack([near, apart(x[leaves[a]], x[leaves[b]])]), k, axis=1)[:, : k + 1], axis=1)
            yield a, near[:, k]

    core = np.empty(n)
    for a, c in sc.parallelize(range(len(leaves)), parts).mapPartitions(cores).collect():
        core[leaves[a]] = c
    component, edges = np.arange(n), []
    while len(edges) < n - 1:
        state = sc.broadcast((core, component, np.array([component[o].min() for o in leaves]), np.array([component[o].max() for o in leaves])))

        def nearest(numbers: Iterator[int], state=state) -> Iterator[tuple[int, tuple[float, int, int]]]:
            x, leaves, _, _ = given.value
            core, component, least, most_ = state.value
            best: dict[int, tuple[float, int, int]] = {}
            for a in numbers:
                own = leaves[a]
                names, mine = np.unique(component[own], return_inverse=True)
                floor = np.array([core[own[mine == c]].min() for c in range(len(names))])
                found = [best.get(int(c), (np.inf, n, n)) for c in names]
                order, gaps = ahead(a)
                other = ~((least[order] == most_[order]) & (least[order] == names[0])) if len(names) == 1 else np.ones(len(order), bool)
                for b, gap in zip(order[other], gaps[other], strict=True):
                    open_ = [c for c in range(len(names)) if max(gap, floor[c]) <= found[c][0]]
                    if not open_:
                        break
                    to = leaves[b]
                    i = np.flatnonzero(np.isin(mine, open_))
                    d = np.maximum(np.maximum(apart(x[own[i]], x[to]), core[own[i], None]), core[to])
                    d[component[own[i], None] == component[to]] = np.inf
                    row = d.min(1)
                    for c in open_:
                        w = row[mine[i] == c].min()
                        if w <= found[c][0] and w < np.inf:
                            p, q = np.nonzero((d == w) & (mine[i] == c)[:, None])
                            ends = own[i[p]], to[q]
                            u, v = np.minimum(*ends), np.maximum(*ends)
                            e = int(np.lexsort((v, u))[0])
                            found[c] = min(found[c], (float(w), int(u[e]), int(v[e])))
                for c, e in zip(names, found, strict=True):
                    best[int(c)] = e
            yield from best.items()

        chosen: dict[int, tuple[float, int, int]] = {}
        for c, e in sc.parallelize(range(len(leaves)), parts).mapPartitions(nearest).collect():
            chosen[c] = min(chosen.get(c, e), e)
        state.unpersist()
        parent = {c: c for c in chosen}

        def root(c: int, parent=parent) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for w, u, v in sorted(chosen.values()):
            r, q = root(int(component[u])), root(int(component[v]))
            if r != q:
                parent[r] = q
                edges.append((w, u, v))
        to = np.arange(n)
        to[list(parent)] = [root(c) for c in parent]
        component = to[component]
    given.unpersist()
    return edges


def maximal_marginal_relevance(topic_vec: np.ndarray, term_vecs: np.ndarray, terms: list[str], n: int = 10, diversity: float = 0.3) -> list[str]:
    """Terms near the topic and unlike those taken before."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    t, c = unit(term_vecs), unit(topic_vec)
    near, alike = t @ c, t @ t.T
    picked = [int(near.argmax())]
    while len(picked) < min(n, len(terms)):
        score = (1 - diversity) * near - diversity * alike[:, picked].max(1)
        score[picked] = -np.inf
        picked.append(int(score.argmax()))
    return [terms[i] for i in picked]


def fit_composed(docs: DataFrame, id_col: str, text: str, encoder: Z.Encoder | None = None, components: int = 5, min_cluster_size: int = 15, min_samples: int = 5, diversity: float | None = None, reduce_frequent: bool = False, bm25: bool = False) -> TopicModel:
    """Embed, reduce, cluster by density, name the topics by class TF-IDF (and marginal relevance); -1 is ``Other``."""
    encode = encoder or Z.hashed_encoder()
    vectors = materialise(Z.embed(docs, id_col, text, encode))
    low = Z.project(vectors, id_col, "embedding", components)
    low = low.select(id_col, F.array(*[F.col(f"x{i + 1}") for i in range(components)]).alias("v"))
    assigned = materialise(fit_density(low, id_col, "v", min_cluster_size, min_samples))
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(assigned.select("id", "topic_id"), "id")
    words = Z.top_terms(Z.class_tfidf(labelled.where("topic_id >= 0"), "topic_id", "t", reduce_frequent, bm25), 20)
    own = vectors.select(F.col(id_col).alias("id"), "embedding").join(assigned.where("topic_id >= 0").select("id", "topic_id"), "id")
    held = {r.group: r.v for r in V.mean_vectors(own, "topic_id", "embedding").collect()}  # one vector a topic
    matrix = np.array([held[i] for i in sorted(held)]) if held else None
    if diversity is not None and matrix is not None:
        rows = []
        for topic, own in itertools.groupby(words.orderBy("topic", "rank").collect(), key=lambda r: r.topic):
            terms = [r.term for r in own]
            picked = maximal_marginal_relevance(matrix[sorted(held).index(topic)], encode(pd.Series(terms)), terms, 10, diversity)
            rows += [(topic, w, 1.0 - 0.05 * i, i + 1) for i, w in enumerate(picked)]
        words = docs.sparkSession.createDataFrame(rows, "topic int, term string, weight double, rank int")
    return TopicModel("bertopic", assigned, words, matrix)


def fit_topic_vectors(docs: DataFrame, id_col: str, text: str, num_topics: int | None = None, encoder: Z.Encoder | None = None, min_cluster_size: int = 15) -> TopicModel:
    """Density topics with mean vectors; reduced to ``num_topics`` by merging the smallest into its nearest."""
    model = fit_composed(docs, id_col, text, encoder, min_cluster_size=min_cluster_size)
    if model.centers is None:
        return model
    sizes = {r.topic_id: r["count"] for r in model.assigned.where("topic_id >= 0").groupBy("topic_id").count().collect()}
    merged = merge_smallest(model.centers, np.array([sizes[i] for i in sorted(sizes)]), num_topics) if num_topics else np.arange(len(model.centers))
    mapping = F.create_map(*[F.lit(int(x)) for i, g in enumerate(merged) for x in (i, g)])
    assigned = materialise(model.assigned.withColumn("topic_id", F.when(F.col("topic_id") < 0, -1).otherwise(mapping[F.col("topic_id")])))
    weights = np.array([sizes[i] for i in sorted(sizes)], float)
    centers = np.array([np.average(model.centers[merged == g], axis=0, weights=weights[merged == g]) for g in range(merged.max() + 1)])
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(assigned.where("topic_id >= 0").select("id", "topic_id"), "id")
    return TopicModel("top2vec", assigned, Z.top_terms(Z.class_tfidf(labelled, "topic_id", "t"), 20), centers)


def merge_smallest(centers: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """New group of each topic after merging the smallest into its cosine-nearest until ``k`` are left."""
    groups, c, n = [[i] for i in range(len(centers))], [np.asarray(x, float) for x in centers], [float(s) for s in sizes]
    while len(groups) > k:
        i = int(np.argmin(n))
        u = [x / max(np.linalg.norm(x), 1e-12) for x in c]
        j = max((j for j in range(len(c)) if j != i), key=lambda j: (float(u[i] @ u[j]), -j))
        c[j] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j])
        n[j] += n[i]
        groups[j] += groups[i]
        del groups[i], c[i], n[i]
    out = np.empty(len(centers), np.int64)
    for g, own in enumerate(sorted(groups, key=min)):
        out[own] = g
    return out


def hierarchy(spark: SparkSession, centers: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """(step, left, right, merged, distance, size): topics merged two by two, the nearest by cosine first, to a single one.

    Topics keep their numbers; the n-th merge makes topic k - 1 + n. Vectors are averaged by size; the topics are as many as the model has.
    """
    names, c, n, out = list(range(len(centers))), [np.asarray(x, float) for x in centers], [int(s) for s in sizes], []
    while len(names) > 1:
        u = np.stack(c) / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        d = 1 - u @ u.T
        d[np.tril_indices(len(d))] = np.inf
        i, j = np.unravel_index(d.argmin(), d.shape)
        merged = len(centers) + len(out)
        out.append((len(out) + 1, names[i], names[j], merged, float(max(d[i, j], 0.0)), n[i] + n[j]))
        c[i], n[i], names[i] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j]), n[i] + n[j], merged
        del c[j], n[j], names[j]
    return spark.createDataFrame(out, "step int, left int, right int, merged int, distance double, size long")


def update(model: TopicModel, docs: DataFrame, id_col: str, text: str, encoder: Z.Encoder | None = None) -> TopicModel:
    """A model of topic vectors with further documents: each goes to its nearest topic, and the topics' vectors move by the documents they gain.

    Documents that the model holds already are left out; the words stay as they were fitted.
    """
    if model.centers is None:
        raise ValueError(f"{model.method} has no topic vectors")
    new = docs.join(model.assigned.select(F.col("id").alias(id_col)), id_col, "left_anti")
    vectors = materialise(Z.embed(new, id_col, text, encoder))
    total, count = nearest_sums(vectors, "embedding", model.centers)
    sizes = {r.topic_id: r["count"] for r in model.assigned.where("topic_id >= 0").groupBy("topic_id").count().collect()}
    held = np.array([sizes.get(i, 0) for i in range(len(model.centers))], float)
    centers = (model.centers * held[:, None] + total) / np.maximum(held + count, 1)[:, None]
    centers[held + count == 0] = model.centers[held + count == 0]
    more = assign_to_centers(vectors, id_col, "embedding", model.centers).select("id", "topic_id", "probability")
    return TopicModel(model.method, materialise(model.assigned.select("id", "topic_id", "probability").unionByName(more)), model.words, centers, model.vocab, model.components, model.extra)


def discover(docs: DataFrame, id_col: str, text: str, method: str = "tfidf", num_topics: int = 10, seed: int = 42, **options) -> TopicModel:
    """One door to all models."""
    if method in ("simple_kmeans", "embedding_cluster"):
        return fit_kmeans_embeddings(docs, id_col, text, materialise(Z.embed(docs, id_col, text, options.pop("encoder", None))), "embedding", num_topics, seed=seed, **options)
    if method == "tfidf":
        return fit_tfidf_kmeans(docs, id_col, text, num_topics, seed=seed, **options)
    if method == "nmf":
        return fit_nmf(docs, id_col, text, num_topics, seed=seed, **options)
    if method == "lsa":
        return fit_lsa(docs, id_col, text, num_topics, **options)
    if method == "lda":
        return fit_lda(docs, id_col, text, num_topics, seed=seed, **options)
    if method == "bertopic":
        return fit_composed(docs, id_col, text, **options)
    if method == "top2vec":
        return fit_topic_vectors(docs, id_col, text, num_topics, **options)
    raise ValueError(f"unknown method {method}")


def model_metrics(words: DataFrame, assigned: DataFrame) -> dict[str, float]:
    """Topics, diversity, coherence, outliers and their product."""
    top = [(r.topic, r.term, r.weight) for r in words.where("rank <= 10").collect()]  # ten words a topic
    by: dict[int, dict[str, float]] = {}
    for t, w, x in top:
        by.setdefault(t, {})[w] = x
    n = len(by)
    pairs = [len(a.keys() & b.keys()) / len(a.keys() | b.keys()) for a, b in itertools.combinations(by.values(), 2)]
    diversity = 1 - float(np.mean(pairs)) if pairs else 1.0
    coherence = float(np.mean([np.mean(list(v.values())) for v in by.values()])) if by else 0.0
    total, noise = assigned.agg(F.count("*"), F.count_if(F.col("topic_id") < 0)).first()
    outliers = 100.0 * noise / total if total else 0.0
    return {"n_topics": n, "diversity": diversity, "coherence": coherence, "outliers": outliers, "combined": n * diversity * coherence * (100 - outliers) / 100}


def search_parameters(fit: Callable[..., TopicModel], grid: dict[str, list], metric: str = "combined", how: str = "random", trials: int = 10, seed: int = 42, scorer: Callable[[TopicModel], float] | None = None) -> list[dict]:
    """Trials of a grid (``grid``: a sample of all combinations, ``random``, ``progressive``: one parameter after the other), best first."""
    rng = np.random.default_rng(seed)
    names = sorted(grid)
    out: list[dict] = []

    def run(params: dict) -> float:
        model = fit(**params)
        scores = model_metrics(model.words, model.assigned)
        score = scorer(model) if scorer else scores[metric]
        out.append({"params": params, "score": score, **scores})
        return score

    if how == "progressive":
        best = {k: grid[k][0] for k in names}
        for k in names:
            scored = [(run(best | {k: v}), i) for i, v in enumerate(grid[k][:trials])]
            best[k] = grid[k][max(scored, key=lambda x: (x[0], -x[1]))[1]]
    else:
        every = [dict(zip(names, c, strict=True)) for c in itertools.product(*(grid[k] for k in names))]
        order = rng.permutation(len(every))[:trials] if how == "random" or len(every) > trials else range(len(every))
        for i in order:
            run(every[int(i)])
    return sorted(out, key=lambda r: -r["score"])
