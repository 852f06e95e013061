"""What SQL can say about results it can't compute: encoders, models, classifiers and streams.

Each query here runs the query of the same name without ``_facts`` and states facts about every row or about the whole that
must hold for the tables: which documents come out, lengths of vectors, sums and ranges of probabilities, sizes, identities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import vectors as V
from corpusmith.plans import model_queries, more_queries  # noqa: F401
from corpusmith.plans.model_queries import _TF
from corpusmith.plans.registry import QUERIES, query


def _facts(name: str, sql: str, tell: Callable[[DataFrame], DataFrame]) -> None:
    @query(f"{name}_facts", sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return tell(QUERIES[name](spark, d))


# encoders: every document has a vector of 64 entries, of length one if it has a word, else of zeros
_WORDS = r"case when regexp_matches(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') then 1.0 else 0.0 end as length"


def _vectors(id_col: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(F.col(id_col).alias("id"), F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 4).alias("length"))


for _name in ("emb_docs", "emb_cache", "snk_embed", "st_embed"):
    _facts(_name, f"select doc_id as id, 64 as dim, {_WORDS} from documents", _vectors("doc_id"))
_facts("src_scan_embed", f"select doc_id as id, 64 as dim, {_WORDS} from documents where lang = 'fr'", _vectors("id"))
_facts("emb_topics", "select distinct category as id, 64 as dim, 1.0 as length from documents where category is not null", _vectors("category"))
_facts("emb_topic_vec", "select distinct category as id, 64 as dim, 1.0 as length from documents where category is not null", _vectors("topic"))

# principal components: centred, uncorrelated, falling variance
_facts("proj_pca", "select count(*) as rows, true as centred, true as uncorrelated, true as falling from embeddings", lambda df: df.agg(
    F.count("*").alias("rows"), ((F.abs(F.avg("x1")) < 1e-6) & (F.abs(F.avg("x2")) < 1e-6)).alias("centred"), (F.abs(F.corr("x1", "x2")) < 1e-6).alias("uncorrelated"), (F.var_pop("x1") >= F.var_pop("x2")).alias("falling")))

# models: topics hold exactly the documents the method can place, the largest first, with at most twenty words each
_KNOWN = f"with {_TF} select count(distinct doc_id) as documents, true as counted, true as words from tf join vocab using (term)"
_ALL = "select count(*) as documents, true as counted, true as words from documents"


def _topics(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("size").alias("documents"), F.every(F.col("size") == F.col("count")).alias("counted"), F.every(F.coalesce(F.size("words"), F.lit(0)) <= 20).alias("words"))


for _name in ("tm_tfidf", "tm_nmf", "tm_lsa", "tm_topic_info"):
    _facts(_name, _KNOWN, _topics)
for _name in ("tm_simple", "tm_lda", "tm_bertopic", "tm_top2vec"):
    _facts(_name, _ALL, _topics)
_facts("tm_unified", f"with {_TF}, k as (select count(distinct doc_id) as n from tf join vocab using (term)) select unnest(['tfidf', 'lsa']) as method, n as documents from k union all select 'simple_kmeans', count(*) from documents", lambda df: df.groupBy("method").agg(F.sum("size").alias("documents")))

# labels of documents: each placeable document once, its topic among those asked for, its share a share
_DOCS = f"with {_TF} select distinct doc_id as id, true as known, true as share from tf join vocab using (term)"


def _labels(k: int, id_col: str = "id", topic: str = "topic_id", share: str = "probability") -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(F.col(id_col).alias("id"), F.col(topic).between(0, k - 1).alias("known"), F.col(share).between(0, 1 + 1e-6).alias("share"))


_facts("tm_base", _DOCS, _labels(5))
_facts("snk_model", _DOCS, _labels(4))
_facts("tm_doc_info", _DOCS, _labels(5, "doc_id", "topic", "weight"))
_facts("tm_doc_topics", "select doc_id as id, true as known, true as share from documents", _labels(5))
for _name, _k in (("tm_discover", 8), ("wf_run", 6)):
    _facts(_name, "select doc_id as id, true as fits from documents", lambda df, k=_k: df.select(F.col("doc_id").alias("id"), F.coalesce(F.regexp_extract("topic", r"Topic_(\d+)", 1).cast("int").between(0, k - 1) & F.col("topic_probability").between(0, 1 + 1e-6), F.col("topic_probability").isNull()).alias("fits")))

# clusters of vectors: every vector once, as many clusters as asked for
for _name, _k in (("cl_kmeans_fit", 10), ("cl_agglo", 8)):
    _facts(_name, f"select count(*) as rows, count(*) as ids, {_k} as clusters from embeddings", lambda df: df.agg(F.count("*").alias("rows"), F.count_distinct(df.columns[0]).alias("ids"), F.count_distinct("topic_id").alias("clusters")))
_facts("st_fit", "select count(*) as rows, count(distinct doc_id) as ids, 5 as clusters from documents", lambda df: df.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("topic_id").alias("clusters")))
_facts("cl_hdbscan", "select count(*) as rows, count(*) as ids, true as large from embeddings", lambda df: df.groupBy("topic_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("k")).agg(F.sum("n").alias("rows"), F.sum("k").alias("ids"), F.every((F.col("topic_id") < 0) | (F.col("n") >= 10)).alias("large")))
_facts("cl_wrap", "select unnest(['kmeans', 'hdbscan', 'agglomerative']) as algorithm, (select count(*) from embeddings) as rows", lambda df: df.groupBy("algorithm").agg(F.sum("size").alias("rows")))
_facts("st_update", "select unnest(range(5)) as topic, 64 as dim", lambda df: df.select(F.col("topic").cast("bigint").alias("topic"), F.size("center").alias("dim")))

# classifiers: every vector gets one of the labels or Unknown, and shares that add up to one
_LABELS = "select vec_id, true as known, 1.0 as total from embeddings"


def _classes(df: DataFrame) -> DataFrame:
    known = F.col("label").rlike("^(label_[0-9]|Unknown)$")
    return df.select("vec_id", known.alias("known"), F.round(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


for _name in ("sup_classify", "sup_classify_logistic", "sup_classify_random_forest", "sup_classify_svm", "sup_classify_xgboost", "sup_predict"):
    _facts(_name, _LABELS, _classes)
_facts("sup_match_facade", "select doc_id as id, true as fits from documents", lambda df: df.select("id", ((F.col("primary_topic") == "Unknown") == (F.col("topic_probability") < 0.1)).alias("fits")))

# choices and searches
_facts("al_diverse", "select 20 as rows, 20 as ids", lambda df: df.agg(F.count("*").alias("rows"), F.count_distinct(df.columns[0]).alias("ids")))
_facts("al_combined", "select 30 as rows, 30 as ids", lambda df: df.agg(F.count("*").alias("rows"), F.count_distinct(df.columns[0]).alias("ids")))
_facts("opt_metrics", "select 6.0 as topics, true as product", lambda df: df.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m")).select(F.expr("m['n_topics']").alias("topics"), F.expr("abs(m['combined'] - m['n_topics'] * m['diversity'] * m['coherence'] * (100 - m['outliers']) / 100) < 1e-9").alias("product")))
_facts("opt_search", "select 2 as trials, true as falling", lambda df: df.agg(F.count("*").alias("trials"), F.every(F.col("score") > 0).alias("falling")))
_facts("udf_grid", "select 2 as trials", lambda df: df.agg(F.count("*").alias("trials")))
_facts("udf_scorer", "select * from (values ('{''num_topics'': 3}', -3.0), ('{''num_topics'': 5}', -5.0)) v(params, score)", lambda df: df)
_facts("opt_repr", "select true as ten, true as ranked", lambda df: df.groupBy("topic").agg(F.count("*").alias("n"), F.max("rank").alias("r")).agg(F.every(F.col("n") <= 10).alias("ten"), F.every(F.col("n") == F.col("r")).alias("ranked")))
