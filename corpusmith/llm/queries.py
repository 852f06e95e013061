"""The queries of the nine problems, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import clusters, knn, leakage, mojibake, neardup, packing, pii, terms, topn
from corpusmith.llm.common import one_per_id

NEAR, LINKED, CLUSTER_SIZE = 0.94, 0.66, 5


def _table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet").select(*cols)


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return knn.most_similar(_table(spark, d, "document_embeddings", "doc_id", "embedding"), "doc_id", "embedding", 5)


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).withColumn("cosine", F.round("cosine", 6))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = _neighbours(spark, d).where(F.col("cosine") >= NEAR)
    return near.select(F.least("doc_id", "neighbour").alias("doc_id_a"), F.greatest("doc_id", "neighbour").alias("doc_id_b")).distinct()


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(_table(spark, d, "sample_documents", "doc_id", "text"), "doc_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where("mark is not null").select("term", "mark")


def p3_best(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(_table(spark, d, "sample_documents", "doc_id", "topic", "topic_probability"), "topic", "topic_probability", "doc_id", 3, 0.0, 1.0)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_best(spark, d).select("topic", "doc_id")


def _duplicates(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.near_duplicates(_table(spark, d, "sample_documents", "doc_id", "text"), "doc_id", "text", least=0.5, width=3, min_words=12)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_groups(_duplicates(spark, d)).select(F.col("id").alias("doc_id"), F.col("group").alias("group_doc_id"), "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_pairs(_duplicates(spark, d)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = clusters.similarity_clusters(_table(spark, d, "document_embeddings", "doc_id", "embedding"), "doc_id", "embedding", LINKED, CLUSTER_SIZE)
    return found.select(F.col("cluster").alias("cluster_doc_id"), "doc_id")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size, typical documents and topics (most frequent first, with counts) of each cluster."""
    members = p5_found(spark, d).withColumnRenamed("cluster_doc_id", "cluster")
    told = clusters.describe_clusters(members, _table(spark, d, "document_embeddings", "doc_id", "embedding"), "doc_id", "embedding")
    topics = one_per_id(_table(spark, d, "sample_documents", "doc_id", "topic"), "doc_id", "topic").where("topic is not null")
    counts = members.join(topics, "doc_id").groupBy("cluster", "topic").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "topic"))).alias("t"))
    carried = ranked.select("cluster", F.transform("t", lambda x: F.concat(x["topic"], F.lit(":"), (-x["minus"]).cast("string"))).alias("topics"))
    return told.join(carried, "cluster", "left").select(F.col("cluster").alias("cluster_doc_id"), "size", "typical", "topics")


def p5_text_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The notes themselves: hashed weighted features, k-means, sizes and typical notes."""
    docs = one_per_id(_table(spark, d, "sample_documents", "doc_id", "text"), "doc_id", "text")
    return clusters.kmeans_clusters(clusters.text_vectors(docs, "doc_id", "text"), "doc_id", "embedding", 50)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_details(_table(spark, d, "sample_documents", "doc_id", "text"), "doc_id", "text", _table(spark, d, "name_lexicon", "name", "kind"))


def p6_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text with typed placeholders; of repeated rows one."""
    docs = one_per_id(_table(spark, d, "sample_documents", "doc_id", "text"), "doc_id", "text")
    return pii.sanitise(docs, "doc_id", "text", _table(spark, d, "name_lexicon", "name", "kind")).select("doc_id", "sanitised", F.size("details").alias("details"))


def p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_sequences(_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    corpus, items = _table(spark, d, "documents", "doc_id", "text"), _table(spark, d, "eval_items", "item_id", "text")
    return leakage.leaked_items(corpus, "doc_id", "text", items, "item_id", "text").select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged_documents(_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore_documents(_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_terms, p3_found, p3_best, p4_found, p4_groups, p5_found, p5_clusters, p5_text_clusters, p6_found, p6_sanitised, p7_sequences, p8_found, p9_found, p9_restored)}

_TERMS = r"""
with docs as (select doc_id, min(text) as text from sample_documents where doc_id is not null group by doc_id),
found as (select doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as term from docs),
total as (select count(distinct doc_id) as n from found),
counted as (select term, count(*) as occurrences, count(distinct doc_id) as records from found group by term)
select term, occurrences, records,
       case when records < 3 then 'rare' when records > 0.5 * n then 'common' end as mark
from counted, total
"""
_BEST = """
with docs as (select topic, doc_id, max(topic_probability) as topic_probability from sample_documents
              where topic is not null and doc_id is not null and not isnan(topic_probability) and topic_probability between 0 and 1
              group by topic, doc_id),
placed as (select *, cast(row_number() over (partition by topic order by topic_probability desc, doc_id) as integer) as position from docs)
select topic, doc_id, topic_probability, position from placed where position <= 3
"""
SQL = {
    "p2_terms": _TERMS,
    "p2_found": f"select term, mark from ({_TERMS}) where mark is not null",
    "p3_best": _BEST,
    "p3_found": f"select topic, doc_id from ({_BEST})",
    "p8_found": r"""
with words as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null),
asked as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from eval_items where text is not null),
runs as (select doc_id, array_to_string(w[i:i + 9], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 8)) as i from words where len(w) >= 10)),
passages as (select distinct item_id, array_to_string(w[i:i + 9], ' ') as run from (select item_id, w, unnest(range(1, len(w) - 8)) as i from asked where len(w) >= 10))
select distinct doc_id, item_id from runs join passages using (run)
""",
}
