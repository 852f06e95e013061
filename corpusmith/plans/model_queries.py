"""Vectorising, topic models, matching, comparing, active learning, streaming, sources and sinks."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith import dictionaries as D
from corpusmith.functions import text as T
from corpusmith.functions import vectors as V
from corpusmith.operators import compare, feedback, matching, models
from corpusmith.operators import vectorize as Z
from corpusmith.plans.pipeline import Workflow
from corpusmith.plans.registry import query, table
from corpusmith.session import work_path
from corpusmith.sources import readers, writers
from corpusmith.streaming import jobs


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("name", F.concat(F.lit("label_"), "label"))


_TF = r"""tokens as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) as term from documents), tf as (select doc_id, term, count(*) as tf from tokens group by 1, 2),
vocab as (select term, sum(tf) as ctf, count(*) as df from tf group by 1 order by 2 desc, 1 limit 1000), n as (select count(*) as n from documents),
idf as (select term, ctf, df, row_number() over (order by term) - 1 as idx, ln((1.0 + n) / (1.0 + df)) + 1 as idf from vocab, n)"""
_TFIDF = _TF + """, raw as (select doc_id, term, idx, tf, tf * idf as raw from tf join idf using (term)), w as (select doc_id, term, idx, tf, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as weight from raw)"""


@query("vec_count", f"with {_TF} select doc_id as id, term, tf from tf join vocab using (term)")
def vec_count(spark: SparkSession, d: str) -> DataFrame:
    tf = Z.term_frequencies(_docs(spark, d), "doc_id", "text")
    return tf.join(F.broadcast(Z.vocabulary(tf, 1000).select("term")), "term").select("id", "term", "tf")


@query("vec_tfidf", f"with {_TFIDF} select doc_id as id, term, tf, round(weight, 6) as weight from w")
def vec_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return Z.fit_tfidf(_docs(spark, d), "doc_id", "text")[0].select("id", "term", "tf", F.round("weight", 6).alias("weight"))


@query("vec_transform", f"with {_TF}, new as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from (select doc_id, min(text) as text from sample_documents group by 1)), ntf as (select doc_id, term, count(*) as tf from new group by 1, 2), raw as (select doc_id, term, tf * idf as raw from ntf join idf using (term)) select doc_id as id, term, round(raw / sqrt(sum(raw * raw) over (partition by doc_id)), 6) as weight from raw")
def vec_transform(spark: SparkSession, d: str) -> DataFrame:
    _, vocab = Z.fit_tfidf(_docs(spark, d), "doc_id", "text")
    new = table(spark, d, "sample_documents").groupBy("doc_id").agg(F.min("text").alias("text"))
    return Z.tfidf(Z.term_frequencies(new, "doc_id", "text"), vocab).select("id", "term", F.round("weight", 6).alias("weight"))


@query("vec_bow_extremes", f"with {_TF}, k as (select term, sum(tf) as ctf, count(*) as df from tf group by 1 having count(*) >= 2), m as (select count(distinct doc_id) as m from tf) select term, cast(ctf as bigint) as ctf, df from k, m where df <= 0.9 * m")
def vec_bow_extremes(spark: SparkSession, d: str) -> DataFrame:
    return Z.vocabulary(Z.term_frequencies(_docs(spark, d), "doc_id", "text"), 100_000, 2, 0.9).select("term", "ctf", "df")


_CTFIDF = r"""tokens as (select category as topic, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) as term from documents where category is not null), c as (select topic, term, count(*) as tf from tokens group by 1, 2),
s as (select topic, sum(tf) as size from c group by 1), f as (select term, sum(tf) as f from c group by 1), a as (select avg(size) as a from s), cw as (select c.topic, c.term, c.tf / s.size * ln(1 + a / f) as weight from c join s using (topic) join f using (term), a)"""


@query("vec_ctfidf", f"with {_CTFIDF} select topic, term, round(weight, 9) as weight from cw")
def vec_ctfidf(spark: SparkSession, d: str) -> DataFrame:
    return Z.class_tfidf(_docs(spark, d), "category", "text").withColumn("weight", F.round("weight", 9))


_TOP = f"with {_CTFIDF}, r as (select topic, term, round(weight, 6) as weight from cw), t as (select topic, term, weight, cast(row_number() over (partition by topic order by weight desc, term) as integer) as rank from r)"


def _top(spark: SparkSession, d: str, n: int = 20, topic: str = "category") -> DataFrame:
    return Z.top_terms(Z.class_tfidf(_docs(spark, d).where(F.col(topic).isNotNull()), topic, "text"), n)


@query("topk_terms", f"{_TOP} select * from t where rank <= 20")
def topk_terms(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d)


@query("tm_weights", f"{_TOP} select topic, term, greatest(0.0, 1.0 - 0.05 * (rank - 1)) as weight, rank from t where rank <= 20")
def tm_weights(spark: SparkSession, d: str) -> DataFrame:
    return models.rank_weights(_top(spark, d))


@query("tm_label", f"{_TOP} select topic, upper(max(term) filter (rank = 1)[:1]) || max(term) filter (rank = 1)[2:] || ': ' || string_agg(term, ', ' order by rank) filter (rank > 1) as name from t where rank <= 4 group by 1")
def tm_label(spark: SparkSession, d: str) -> DataFrame:
    return Z.topic_label(_top(spark, d))


@query("tm_tfidf_terms", f"with {_TFIDF}, s as (select source as topic, term, round(sum(weight), 6) as weight from w join documents using (doc_id) where source is not null group by 1, 2) select topic, term, weight, cast(row_number() over (partition by topic order by weight desc, term) as integer) as rank from s qualify rank <= 10")
def tm_tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    """The ten terms with the highest summed TF-IDF of each source: the keyword half of the TF-IDF model."""
    docs = _docs(spark, d)
    weights, _ = Z.fit_tfidf(docs, "doc_id", "text")
    summed = weights.join(docs.where("source is not null").select(F.col("doc_id").alias("id"), F.col("source").alias("topic")), "id").groupBy("topic", "term").agg(F.sum("weight").alias("weight"))
    return Z.top_terms(summed, 10)


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    return Z.embed(_docs(spark, d), "doc_id", "text")


@query("emb_docs")
def emb_docs(spark: SparkSession, d: str) -> DataFrame:
    return _embedded(spark, d)


@query("emb_topics")
def emb_topics(spark: SparkSession, d: str) -> DataFrame:
    topics = _docs(spark, d).where("category is not null").select("category").distinct().withColumn("t", F.concat("category", F.lit(": insurance claims")))
    return Z.embed(topics, "category", "t")


@query("emb_topic_vec")
def emb_topic_vec(spark: SparkSession, d: str) -> DataFrame:
    words = _top(spark, d, 10).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("t"))
    return Z.embed(words, "topic", "t")


@query("emb_cache")
def emb_cache(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "embeddings")
    docs = _docs(spark, d)
    Z.embed_cached(docs, "doc_id", "text", path).count()
    return Z.embed_cached(docs, "doc_id", "text", path)


@query("proj_pca")
def proj_pca(spark: SparkSession, d: str) -> DataFrame:
    return Z.project(table(spark, d, "embeddings"), "vec_id", "embedding", 2)


# models
def _model(spark: SparkSession, d: str, method: str, **options) -> models.TopicModel:
    return models.discover(_docs(spark, d), "doc_id", "text", method, **options)


for _name, _method, _options in (("tm_simple", "simple_kmeans", {}), ("tm_tfidf", "tfidf", {}), ("tm_nmf", "nmf", {}), ("tm_lsa", "lsa", {}), ("tm_lda", "lda", {}), ("tm_bertopic", "bertopic", {}), ("tm_top2vec", "top2vec", {"num_topics": 5})):

    @query(_name)
    def _fit(spark: SparkSession, d: str, method: str = _method, options: dict = _options) -> DataFrame:
        return _model(spark, d, method, **options).info()


@query("tm_lda_perplexity", "select true as better_than_chance")
def tm_lda_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """The log perplexity of the fitted documents lies under that of drawing from all words alike."""
    model = _model(spark, d, "lda", num_topics=5)
    bound = model.perplexity(_docs(spark, d), "doc_id", "text")
    return spark.createDataFrame([(0 < bound < float(np.log(len(model.extra["counter"].vocabulary))),)], "better_than_chance boolean")


@query("tm_hierarchy", "with k as (select count(distinct source) as k from documents where source is not null), n as (select count(*) as n from documents where source is not null) select cast(k - 1 as bigint) as merges, n as documents, true as grows from k, n")
def tm_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """The sources' mean vectors merged two by two: one merge less than topics, all documents in the last."""
    docs = _docs(spark, d).where("source is not null")
    means = V.mean_vectors(Z.embed(docs, "doc_id", "text", keep=("source",)), "source", "embedding").orderBy("group").collect()  # one vector a topic
    merged = models.hierarchy(spark, np.array([r.v for r in means]), np.array([r.n for r in means]))
    return merged.agg(F.count("*").alias("merges"), F.max("size").alias("documents"), F.every(F.col("merged") > F.greatest("left", "right")).alias("grows"))


@query("tm_update", "select doc_id as id, true as known from documents")
def tm_update(spark: SparkSession, d: str) -> DataFrame:
    """A model of the English documents that takes in all others: every document ends up with one topic."""
    model = models.discover(_docs(spark, d).where("lang = 'en'"), "doc_id", "text", "simple_kmeans", 6)
    return models.update(model, _docs(spark, d), "doc_id", "text").assigned.select("id", F.col("topic_id").between(0, 5).alias("known"))


@query("tm_doc_info")
def tm_doc_info(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d, "tfidf", num_topics=5).document_info(_docs(spark, d), "doc_id", "text")


@query("tm_discover")
def tm_discover(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", "text", "doc_date")
    return Workflow.start(docs, time="doc_date").discover("tfidf", 8).documents.select("doc_id", "topic", "topic_probability")


@query("tm_doc_topics")
def tm_doc_topics(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d, "lda", num_topics=5).assigned.select("id", "topic_id", F.array_max("distribution").alias("probability"))


_MEANS = "means as (select label, list(x order by j) as v from (select 'label_' || cast(label as varchar) as label, j, avg(x) as x from (select label, cast(unnest(embedding) as double) as x, unnest(range(64)) as j from embeddings) group by 1, 2) group by 1)"
_DOT = "list_sum(list_transform(list_zip(cast({0} as double[]), cast({1} as double[])), lambda p: p[1] * p[2]))"


def _cosine(a: str, b: str) -> str:
    return f"coalesce({_DOT.format(a, b)} / nullif(sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)}), 0), 0)"


_SCORES = f"{_MEANS}, scores as (select vec_id as id, means.label as topic, round({_cosine('embedding', 'v')}, 6) as score from embeddings, means)"


def _topics(spark: SparkSession, d: str) -> list[tuple[str, list[float]]]:
    return matching.topic_list(matching.class_means(_vecs(spark, d), "name", "embedding"), "label", "v")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return matching.similarities(_vecs(spark, d), "vec_id", "embedding", _topics(spark, d), 6)


@query("cl_kmeans", f"with {_MEANS}, d as (select vec_id, label, 1 / (1 + sqrt(list_sum(list_transform(list_zip(cast(embedding as double[]), v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) as p from (select vec_id, embedding, means.label, v from embeddings, means)) select vec_id, label as topic, round(p / sum(p) over (partition by vec_id), 6) as probability from d")
def cl_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Shares of 1 / (1 + distance) for given centres, which are the labels' mean vectors."""
    topics = _topics(spark, d)
    scored = models.assign_to_centers(_vecs(spark, d), "vec_id", "embedding", np.array([v for _, v in topics]))
    names = F.array(*[F.lit(n) for n, _ in topics])
    return scored.select(F.col("id").alias("vec_id"), F.posexplode("probabilities").alias("j", "p")).select("vec_id", F.get(names, F.col("j")).alias("topic"), F.round("p", 6).alias("probability"))


@query("cl_kmeans_fit")
def cl_kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    return models.kmeans_assign(_vecs(spark, d), "vec_id", "embedding", 10, restarts=3)[0].drop("probabilities")


@query("cl_hdbscan")
def cl_hdbscan(spark: SparkSession, d: str) -> DataFrame:
    return models.fit_density(_vecs(spark, d), "vec_id", "embedding", 10, 5)


@query("cl_agglo")
def cl_agglo(spark: SparkSession, d: str) -> DataFrame:
    return models.fit_agglomerative(_vecs(spark, d), "vec_id", "embedding", 8)


@query("cl_centers", f"with {_MEANS} select label, len(v) as dim, round(v[1], 6) as first, round(v[64], 6) as last from means")
def cl_centers(spark: SparkSession, d: str) -> DataFrame:
    means = matching.class_means(_vecs(spark, d), "name", "embedding")
    return means.select("label", F.size("v").cast("long").alias("dim"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query("tm_similar", f"with {_MEANS}, q as (select embedding as q from embeddings where vec_id = (select min(vec_id) from embeddings)) select label as topic, round({_DOT.format('q', 'v')}, 6) as score from means, q order by 2 desc, 1 limit 5")
def tm_similar(spark: SparkSession, d: str) -> DataFrame:
    q = [float(x) for x in _vecs(spark, d).orderBy("vec_id").first().embedding]
    means = matching.class_means(_vecs(spark, d), "name", "embedding")
    return means.select(F.col("label").alias("topic"), F.round(V.dot_literal(F.col("v"), q), 6).alias("score")).orderBy(F.desc("score"), "topic").limit(5)


# matching
@query("jn_cross_doc_topic", f"with {_SCORES} select * from scores")
def jn_cross_doc_topic(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query("sup_match1", f"with {_SCORES} select id, case when score >= 0.2 then topic else 'Unknown' end as primary_topic, score as topic_probability from scores qualify row_number() over (partition by id order by score desc, topic desc) = 1")
def sup_match1(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_one(_vecs(spark, d), "vec_id", "embedding", _topics(spark, d), 0.2, 6)


@query("sup_match_default", f"with {_SCORES} select id, case when score >= 0.6 then topic else 'Unknown' end as primary_topic, score as topic_probability from scores qualify row_number() over (partition by id order by score desc, topic desc) = 1")
def sup_match_default(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_one(_vecs(spark, d), "vec_id", "embedding", _topics(spark, d), digits=6)


@query("sup_matchN", f"with {_SCORES}, r as (select *, row_number() over (partition by id order by score desc, topic desc) as r from scores where score >= 0.2), m as (select id, string_agg(topic, ',' order by r) as topics, round(sum(score), 6) as total from r where r <= 3 group by 1) select vec_id as id, coalesce(topics, 'Unknown') as all_topics, coalesce(total, 0.0) as total from embeddings left join m on vec_id = id")
def sup_match_n(spark: SparkSession, d: str) -> DataFrame:
    out = matching.match_many(_vecs(spark, d), "vec_id", "embedding", _topics(spark, d), 0.2, digits=6)
    return out.select("id", F.array_join("all_topics", ",").alias("all_topics"), F.round(F.aggregate("all_scores", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("sup_match_wide", f"with {_SCORES} select id, " + ", ".join(f"max(score) filter (topic = 'label_{i}') as label_{i}_similarity" for i in range(10)) + " from scores group by 1")
def sup_match_wide(spark: SparkSession, d: str) -> DataFrame:
    return matching.wide(_scores(spark, d), [f"label_{i}" for i in range(10)])


@query("topk_doc_topics", f"with {_SCORES} select id, topic, score, cast(row_number() over (partition by id order by score desc, topic desc) as integer) as rank from scores where score >= 0.1 qualify rank <= 3")
def topk_doc_topics(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("topic"))
    return _scores(spark, d).where("score >= 0.1").withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("sup_match_facade")
def sup_match_facade(spark: SparkSession, d: str) -> DataFrame:
    topics = {"Home": "burst pipe roof kitchen leak", "Auto": "vehicle collision tow windscreen", "Travel": "trip flight luggage cancelled", "Health": "hospital medical injury"}
    return Workflow.start(_docs(spark, d).select("doc_id", "text")).match(topics, threshold=0.1)


for _kind in ("logistic", "random_forest", "svm", "xgboost"):

    @query(f"sup_classify_{_kind}")
    def _classify(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        v = _vecs(spark, d)
        return matching.classify(matching.fit_classifier(v, "name", "embedding", kind), v, "vec_id", "embedding")


@query("sup_predict")
def sup_predict(spark: SparkSession, d: str) -> DataFrame:
    """A saved classifier, loaded again and put to a table of its own."""
    path, v = work_path(spark, "classifier"), _vecs(spark, d)
    matching.fit_classifier(v, "name", "embedding", "logistic").write().overwrite().save(path)
    return matching.classify(PipelineModel.load(path), v.select("vec_id", "embedding"), "vec_id", "embedding")


_BEST = f"{_SCORES}, best as (select id, topic, score from scores qualify row_number() over (partition by id order by score desc, topic desc) = 1), pair as (select 'label_' || cast(label as varchar) as t, topic as p from embeddings join best on vec_id = id)"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    best = matching.match_one(_vecs(spark, d), "vec_id", "embedding", _topics(spark, d), -1.0, 6)
    return _vecs(spark, d).select(F.col("vec_id").alias("id"), "name").join(best, "id")


@query("sup_eval", f"""with {_BEST}, c as (select t, p, count(*) as n from pair group by 1, 2), s as (select t as c, sum(n) as support from c group by 1), q as (select p as c, sum(n) as said from c group by 1), h as (select t as c, n as hit from c where t = p),
m as (select support, coalesce(said, 0) as said, coalesce(hit, 0) as hit from s left join q using (c) left join h using (c)), r as (select *, case when said > 0 then hit / said else 0.0 end as p, hit / support as r from m), f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f1 from r)
select round(sum(hit) / sum(support), 6) as accuracy, round(sum(p * support) / sum(support), 6) as precision, round(sum(r * support) / sum(support), 6) as recall, round(sum(f1 * support) / sum(support), 6) as f1 from f""")
def sup_eval(spark: SparkSession, d: str) -> DataFrame:
    return matching.evaluate(_predicted(spark, d), "name", "primary_topic")


@query("cmp_confusion", f"with {_BEST}, c as (select t as actual, p as predicted, count(*) as count from pair group by 1, 2) select *, round(100.0 * count / sum(count) over (partition by actual), 6) as share from c")
def cmp_confusion(spark: SparkSession, d: str) -> DataFrame:
    return matching.confusion(_predicted(spark, d), "name", "primary_topic")


# comparing
_TOP10 = _TOP + ", ten as (select topic, term from t where rank <= 10)"
_PAIRS = "s as (select topic, count(*) as n from ten group by 1), i as (select a.topic as a, b.topic as b, count(*) as inboth from ten a join ten b on a.term = b.term and a.topic < b.topic group by 1, 2)"


@query("cmp_jaccard", _TOP10 + ", " + _PAIRS.replace("s as", "sz as").replace("from ten group", "from ten group") + " select x.topic as topic_a, y.topic as topic_b, round(coalesce(inboth, 0) / (x.n + y.n - coalesce(inboth, 0)), 6) as similarity from sz x join sz y on x.topic < y.topic left join i on i.a = x.topic and i.b = y.topic")
def cmp_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return compare.jaccard(_top(spark, d, 10))


@query("jn_theta_pairs", "with k as (select distinct category from documents where category is not null) select x.category as a, y.category as b from k x join k y on x.category < y.category")
def jn_theta_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = _docs(spark, d).where("category is not null").select("category").distinct()
    return k.select(F.col("category").alias("a")).join(k.select(F.col("category").alias("b")), F.expr("a < b"))


@query("cmp_landscape", "with c as (select category as topic, count(*) as count from documents where category is not null group by 1) select topic, count, 15.0 + least(35.0, count / 5.0) as size from c")
def cmp_landscape(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).where("category is not null").groupBy(F.col("category").alias("topic")).agg(F.count("*").alias("count"))
    return c.withColumn("size", compare.landscape_size())


@query("cmp_models", _TOP + " select 'ctfidf' as model, topic, string_agg(term, ' ' order by rank) as words from t where rank <= 5 group by 2 union all select 'ranks', topic, string_agg(term, ' ' order by rank) from t where rank <= 5 group by 2")
def cmp_models(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d, 5)
    words = lambda t, m: t.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("words")).select(F.lit(m).alias("model"), "topic", "words")
    return words(top, "ctfidf").unionByName(words(models.rank_weights(top), "ranks"))


@query("cmp_doc_topic", f"with {_SCORES} select id, topic, score from scores where score > 0")
def cmp_doc_topic(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("score > 0")


_MEANS2 = _MEANS.replace("means as", "odd as").replace("from embeddings)", "from embeddings where vec_id % 2 = 1)") + ", " + _MEANS.replace("means as", "even as").replace("from embeddings)", "from embeddings where vec_id % 2 = 0)")


@query("cmp_embed", f"with {_MEANS2}, p as (select odd.label as topic_a, even.label as topic_b, round({_cosine('odd.v', 'even.v')}, 6) as similarity from odd, even) select * from p qualify row_number() over (partition by topic_a order by similarity desc, topic_b) = 1 and similarity > -1")
def cmp_embed(spark: SparkSession, d: str) -> DataFrame:
    """Two models: the labels' means over odd and over even vectors."""
    v = _vecs(spark, d)
    a, b = (matching.class_means(v.where(f"vec_id % 2 = {k}"), "name", "embedding") for k in (1, 0))
    return compare.nearest_topics(a, b, "label", "v", -1.0)


@query("cmp_corr", "with w as (select e[1] as x0, e[2] as x1, e[3] as x2, e[4] as x3 from (select cast(embedding as double[]) as e from embeddings)) " + " union all ".join(f"select 'x{i}' as a, 'x{j}' as b, round(coalesce(covar_pop(x{i}, x{j}) / nullif(stddev_pop(x{i}) * stddev_pop(x{j}), 0), 0), 6) as r from w" for i in range(4) for j in range(i + 1, 4)))
def cmp_corr(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)])
    return compare.correlation(wide, [f"x{i}" for i in range(4)])


_TOPS2 = _CTFIDF.replace("from documents where", "from documents where doc_id % 2 = 1 and") + ", odd as (select * from cw), " + _CTFIDF.replace("tokens as", "tokens2 as").replace("from tokens ", "from tokens2 ").replace("c as (select topic, term, count", "c2 as (select topic, term, count").replace("s as (select topic, sum(tf) as size from c ", "s2 as (select topic, sum(tf) as size from c2 ").replace("f as (select term, sum(tf) as f from c ", "f2 as (select term, sum(tf) as f from c2 ").replace("a as (select avg(size) as a from s)", "a2 as (select avg(size) as a from s2)").replace("cw as (select c.topic, c.term, c.tf / s.size * ln(1 + a / f) as weight from c join s using (topic) join f using (term), a)", "even as (select c2.topic, c2.term, c2.tf / s2.size * ln(1 + a / f) as weight from c2 join s2 using (topic) join f2 using (term), a2)").replace("from documents where", "from documents where doc_id % 2 = 0 and")


@query("cmp_words", f"with {_TOPS2}, d as (select x.topic as topic_a, y.topic as topic_b, sum(x.weight * y.weight) as dot from odd x join even y using (term) group by 1, 2), la as (select topic, sqrt(sum(weight * weight)) as l from odd group by 1), lb as (select topic, sqrt(sum(weight * weight)) as l from even group by 1), p as (select topic_a, topic_b, round(dot / (la.l * lb.l), 6) as similarity from d join la on la.topic = topic_a join lb on lb.topic = topic_b) select * from p qualify row_number() over (partition by topic_a order by similarity desc, topic_b) = 1")
def cmp_words(spark: SparkSession, d: str) -> DataFrame:
    a, b = (Z.class_tfidf(_docs(spark, d).where(f"doc_id % 2 = {k}"), "category", "text") for k in (1, 0))
    return compare.word_match(a, b)


@query("set_words", r"with l as (select distinct category as topic, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) as term, lang from documents where category is not null), a as (select topic, list(distinct term) as w from l where lang = 'en' group by 1), b as (select topic, list(distinct term) as w from l where lang = 'de' group by 1) select a.topic, len(list_intersect(a.w, b.w)) as shared, len(list_filter(a.w, lambda x: not list_contains(b.w, x))) as only_a, len(list_filter(b.w, lambda x: not list_contains(a.w, x))) as only_b from a join b using (topic)")
def set_words(spark: SparkSession, d: str) -> DataFrame:
    words = lambda lang: _docs(spark, d).where((F.col("lang") == lang) & F.col("category").isNotNull()).select(F.col("category").alias("topic"), F.explode(T.words(F.col("text"))).alias("term"))
    return compare.word_sets(words("en"), words("de")).select("topic", *[F.size(c).cast("long").alias(c) for c in ("shared", "only_a", "only_b")])


@query("cmp_prevalence", f"with {_SCORES} select 'cosine' as model, topic, round(avg(score), 7) as mean from scores group by 2 union all select 'squared', topic, round(avg(score * score), 7) from scores group by 2")
def cmp_prevalence(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    both = compare.prevalence(s, "cosine").unionByName(compare.prevalence(s.withColumn("score", F.col("score") * F.col("score")), "squared"))
    return both.withColumn("mean", F.round("mean", 7))


@query("cmp_word_heat", _TOP + ", five as (select distinct term from t where rank <= 5), g as (select * from (select distinct topic from t), five) select g.topic, g.term, coalesce(r.weight, 0.0) as weight from g left join r using (topic, term)")
def cmp_word_heat(spark: SparkSession, d: str) -> DataFrame:
    every = Z.class_tfidf(_docs(spark, d), "category", "text").withColumn("weight", F.round("weight", 6))
    terms = _top(spark, d, 5).select("term").distinct()
    return every.select("topic").distinct().crossJoin(terms).join(every, ["topic", "term"], "left").na.fill(0.0, ["weight"])


@query("cmp_sim_topics", f"with {_CTFIDF}, l as (select topic, sqrt(sum(weight * weight)) as len from cw group by 1), d as (select x.topic, y.topic as other, sum(x.weight * y.weight) as dot from cw x join cw y using (term) where x.topic <> y.topic group by 1, 2), p as (select d.topic, other, round(dot / (l.len * o.len), 6) as similarity from d join l on l.topic = d.topic join l o on o.topic = other) select *, cast(row_number() over (partition by topic order by similarity desc, other) as integer) as rank from p qualify rank <= 3")
def cmp_sim_topics(spark: SparkSession, d: str) -> DataFrame:
    return compare.similar_topics(Z.class_tfidf(_docs(spark, d), "category", "text"))


@query("jn_cross_topic_topic", f"with {_MEANS} select x.label as topic_a, y.label as topic_b, round({_cosine('x.v', 'y.v')}, 6) as similarity from means x, means y where x.label < y.label")
def jn_cross_topic_topic(spark: SparkSession, d: str) -> DataFrame:
    m = matching.class_means(_vecs(spark, d), "name", "embedding")
    pairs = m.select(F.col("label").alias("topic_a"), F.col("v").alias("va")).join(m.select(F.col("label").alias("topic_b"), F.col("v").alias("vb")), F.expr("topic_a < topic_b"))
    return pairs.select("topic_a", "topic_b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))


@query("srch_docs", f"with q as (select embedding as q from embeddings where vec_id = (select min(vec_id) from embeddings)) select vec_id, round({_cosine('embedding', 'q')}, 6) as score from embeddings, q order by 2 desc, 1 limit 10")
def srch_docs(spark: SparkSession, d: str) -> DataFrame:
    q = [float(x) for x in _vecs(spark, d).orderBy("vec_id").first().embedding]
    return compare.search(_vecs(spark, d), "vec_id", "embedding", q, 10, 6)


# active learning: probabilities are shares of 1 + cosine to the labels' means
_PROBS = f"{_SCORES}, probs as (select id, list((1 + score) / total order by topic) as p from (select *, sum(1 + score) over (partition by id) as total from scores) group by 1)"


def _probs(spark: SparkSession, d: str) -> DataFrame:
    cells = _scores(spark, d).withColumn("p", (1 + F.col("score")) / F.sum(1 + F.col("score")).over(Window.partitionBy("id")))
    return cells.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", "p"))), lambda x: x["p"]).alias("p"))


for _how, _sql in (("entropy", "list_sum(list_transform(p, lambda x: case when x > 0 then -x * ln(x) else 0 end))"), ("margin", "1 - (list_reverse_sort(p)[1] - list_reverse_sort(p)[2])"), ("leastconf", "1 - list_max(p)")):

    @query(f"al_{_how}", f"with {_PROBS} select id, round({_sql}, 6) as uncertainty from probs order by 2 desc, 1 limit 50")
    def _uncertain(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        scored = _probs(spark, d).select("id", F.round(feedback.UNCERTAINTY["least_confidence" if how == "leastconf" else how](F.col("p")), 6).alias("uncertainty"))
        return scored.orderBy(F.desc("uncertainty"), "id").limit(50)


@query("al_diverse")
def al_diverse(spark: SparkSession, d: str) -> DataFrame:
    return feedback.diverse(_vecs(spark, d), "vec_id", "embedding", 20)


@query("al_combined")
def al_combined(spark: SparkSession, d: str) -> DataFrame:
    both = _probs(spark, d).join(_vecs(spark, d).select(F.col("vec_id").alias("id"), "embedding"), "id")
    return feedback.combined(both, "id", "p", "embedding", 30)


@query("al_label_issues", f"""with {_PROBS}, k as (select id, label + 1 as k, p from probs join embeddings on vec_id = id), th as (select k, avg(p[k]) as t from k group by 1), m as (select list(t order by k) as t from th),
o as (select id, k, p[k] as self, list_max(list_transform(range(1, 11), lambda i: case when p[i] >= t[i] then round(p[i], 12) else -1 end)) as top, p, t from k, m), b as (select *, list_position(list_transform(range(1, 11), lambda i: p[i] >= t[i] and round(p[i], 12) = top), true) as best from o where top >= 0)
select id, 'label_' || cast(k - 1 as varchar) as given, 'label_' || cast(best - 1 as varchar) as suggested, round(self, 6) as self_confidence from b where best <> k""")
def al_label_issues(spark: SparkSession, d: str) -> DataFrame:
    both = _probs(spark, d).join(_vecs(spark, d).select(F.col("vec_id").alias("id"), "name"), "id")
    return feedback.label_issues(both, "id", "name", "p", [f"label_{i}" for i in range(10)]).withColumn("self_confidence", F.round("self_confidence", 6))


# optimiser
@query("opt_metrics")
def opt_metrics(spark: SparkSession, d: str) -> DataFrame:
    model = _model(spark, d, "tfidf", num_topics=6)
    return spark.createDataFrame([(k, float(v)) for k, v in models.model_metrics(model.words, model.assigned).items()], "metric string, value double")


@query("opt_search")
def opt_search(spark: SparkSession, d: str) -> DataFrame:
    found = models.search_parameters(lambda **p: _model(spark, d, "tfidf", **p), {"num_topics": [4, 8], "max_features": [500]}, how="grid")
    return spark.createDataFrame([(str(r["params"]), r["score"]) for r in found], "params string, score double")


@query("opt_repr")
def opt_repr(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d, "bertopic", diversity=0.3, min_cluster_size=5, min_samples=2).words


# sources and sinks: written to the shared folder and read back
@query("src_csv", "select doc_id, text, lang from documents")
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "docs") + ".csv"
    _docs(spark, d).select("doc_id", "text", "lang").write.options(header="true", escape='"', nullValue="\\N").csv(path)
    df = spark.read.options(header="true", multiLine="true", escape='"', nullValue="\\N", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").schema("doc_id bigint, text string, lang string").csv(path)
    return readers.load(df, readers.CorpusSpec("text", "doc_id"))


@query("src_scan", "select doc_id as id, text from documents where lang = 'de'")
def src_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.scan(spark, f"{d}/documents.parquet", "text", "doc_id", "lang = 'de'")


@query("src_scan_embed")
def src_scan_embed(spark: SparkSession, d: str) -> DataFrame:
    return Z.embed(readers.scan(spark, f"{d}/documents.parquet", "text", "doc_id", F.col("lang") == "fr"), "id", "text")


@query("src_upload", r"select distinct text from (select trim(text, ' ') as text from documents where text is not null and text not like '%' || chr(10) || '%' and text not like '%' || chr(13) || '%') where trim(text) <> ''")
def src_upload(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "upload") + ".txt"
    _docs(spark, d).where(F.col("text").isNotNull() & ~F.col("text").rlike("[\\n\\r]")).select(F.trim("text")).write.text(path)
    return readers.upload(spark, path).distinct()


@query("snk_export", "select doc_id, topic, topic_probability from sample_documents")
def snk_export(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "export")
    writers.export(table(spark, d, "sample_documents").select("doc_id", "topic", "topic_probability"), path, ("parquet", "json"))
    return spark.read.parquet(f"{path}/results.parquet")


@query("snk_export_csv", "select vec_id, label, embedding[1] as embedding_0, embedding[64] as embedding_63 from embeddings")
def snk_export_csv(spark: SparkSession, d: str) -> DataFrame:
    """CSV with one column an entry of the vectors, read back as they were stored."""
    path = work_path(spark, "export")
    writers.export(table(spark, d, "embeddings"), path, ("csv",), "embedding", 64)
    return spark.read.options(header="true").schema("vec_id bigint, label int, " + ", ".join(f"embedding_{i} float" for i in range(64))).csv(f"{path}/results.csv").select("vec_id", "label", "embedding_0", "embedding_63")


@query("snk_feedback", "select doc_id, original_topic, corrected_topic, original_topic is distinct from corrected_topic as changed from feedback_log")
def snk_feedback(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "feedback")
    writers.export_feedback(table(spark, d, "feedback_log").select("doc_id", "original_topic", "corrected_topic"), path, "original_topic", "corrected_topic")
    return spark.read.options(header="true", escape='"').schema("doc_id string, original_topic string, corrected_topic string, changed boolean").csv(path)


@query("snk_embed")
def snk_embed(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "vectors")
    writers.append_embeddings(_embedded(spark, d), path)
    return spark.read.parquet(path)


@query("snk_model")
def snk_model(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "model")
    _model(spark, d, "tfidf", num_topics=4).save(path)
    return models.TopicModel.load(spark, path).transform(_docs(spark, d), "doc_id", "text").drop("probabilities")


@query("team_ops", "select trim(term) as term, max(trim(replacement)) as replacement, kind from team_terms where trim(term) <> '' and trim(replacement) <> '' group by 1, 3")
def team_ops(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "team_terms")
    team = D.TeamConfig("claims", D.as_dict(D.clean_terms(t, "acronym")), D.as_dict(D.clean_terms(t, "correction")))
    return team.to_table(spark)


@query("wf_run")
def wf_run(spark: SparkSession, d: str) -> DataFrame:
    known = D.as_dict(D.clean_terms(table(spark, d, "team_terms"), "acronym"))
    flow = Workflow.start(_docs(spark, d).select("doc_id", "text", "doc_date", "category"), time="doc_date", category="category").run(known, method="tfidf", num_topics=6)
    return flow.documents.select("doc_id", "topic", "topic_probability")


# streaming
def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    held = table(spark, d, name)
    return spark.readStream.schema(held.schema).parquet(f"{d}/{name}.parquet*")


@query("st_apply", f"with {_MEANS}, d as (select vec_id, label, sqrt(list_sum(list_transform(list_zip(cast(embedding as double[]), v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as dist from (select vec_id, embedding, means.label, v from embeddings, means)) select vec_id, label as topic from d qualify row_number() over (partition by vec_id order by dist, label) = 1")
def st_apply(spark: SparkSession, d: str) -> DataFrame:
    topics = _topics(spark, d)
    out, check = work_path(spark, "scored"), work_path(spark, "check")
    scored = jobs.score_stream(_stream(spark, d, "embeddings"), "vec_id", "embedding", np.array([v for _, v in topics]))
    jobs.to_table(scored, out, check).awaitTermination()
    return spark.read.parquet(out).select("vec_id", F.get(F.array(*[F.lit(n) for n, _ in topics]), F.col("topic")).alias("topic"))


@query("st_embed")
def st_embed(spark: SparkSession, d: str) -> DataFrame:
    out, check = work_path(spark, "embedded"), work_path(spark, "check")
    jobs.to_table(jobs.embed_stream(_stream(spark, d, "documents"), "doc_id", "text"), out, check).awaitTermination()
    return spark.read.parquet(out)


@query("st_windows", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type as topic, count(*) as count, round(coalesce(sum(value), 0), 4) as total from events where ts is not null and event_type is not null group by 1, 2")
def st_windows(spark: SparkSession, d: str) -> DataFrame:
    counts = jobs.topic_counts(_stream(spark, d, "events"), "ts", "event_type", value="value")
    sink = jobs.Latest(work_path(spark, "windows"), "window_start", "topic")
    counts.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", work_path(spark, "check")).trigger(availableNow=True).start().awaitTermination()
    return sink.read(spark).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "topic", "count", F.round("total", 4).alias("total"))


@query("st_update")
def st_update(spark: SparkSession, d: str) -> DataFrame:
    refresh = jobs.Refresh(work_path(spark, "refresh"), "embedding", 5)
    q = _stream(spark, d, "embeddings").writeStream.foreachBatch(refresh).option("checkpointLocation", work_path(spark, "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(refresh.centers(spark))], "topic int, center array<double>")
