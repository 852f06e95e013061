"""Facades, reports, extension points and the remaining streaming and configuration operators."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith import config
from corpusmith import dictionaries as D
from corpusmith.functions import text as T
from corpusmith.operators import feedback, models, prepare, series
from corpusmith.operators import vectorize as Z
from corpusmith.plans import model_queries as M
from corpusmith.plans import series_queries as S
from corpusmith.plans import text_queries as X
from corpusmith.plans.pipeline import Workflow
from corpusmith.plans.registry import QUERIES, SQL, query, table
from corpusmith.session import shared_dir, work_path
from corpusmith.sources import readers, writers
from corpusmith.streaming import jobs


def _same(name: str, as_: str) -> None:
    """Another door to the same operator."""
    QUERIES[name] = QUERIES[as_]
    if as_ in SQL:
        SQL[name] = SQL[as_]


for _a, _b in (
    ("fb_impact", "agg_transitions"), ("fb_compare", "jn_full_counts"), ("fb_delta", "agg_feedback_delta"), ("sup_classify", "sup_classify_logistic"), ("tm_topic_info", "tm_tfidf"),
):
    _same(_a, _b)


# preprocessing facades
@query("wf_expand", SQL["acr_expand"])
def wf_expand(spark: SparkSession, d: str) -> DataFrame:
    known = D.as_dict(D.clean_terms(table(spark, d, "team_terms"), "acronym"))
    return Workflow.start(table(spark, d, "sample_documents")).expand_acronyms(known).documents.select("doc_id", "text")


@query("wf_correct", SQL["spell_text"])
def wf_correct(spark: SparkSession, d: str) -> DataFrame:
    known = D.as_dict(D.clean_terms(table(spark, d, "team_terms"), "correction"))
    return Workflow.start(table(spark, d, "documents")).correct_spelling(known).documents.select("doc_id", "text")


_ADDED = "known as (" + X._CLEAN.format("correction") + " union all select 'adjustr', 'adjuster')"


@query("spell_add", SQL["spell_word"].replace("known as (" + X._CLEAN.format("correction") + ")", _ADDED))
def spell_add(spark: SparkSession, d: str) -> DataFrame:
    fix = D.as_dict(D.clean_terms(table(spark, d, "team_terms"), "correction")) | {"adjustr": "adjuster"}
    words = table(spark, d, "sample_documents").select(F.explode(F.regexp_extract_all(F.lower(T.text_or_empty(F.col("text"))), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return prepare.corrections_of(words, "word", fix)


# models behind one interface
@query("tm_base")
def tm_base(spark: SparkSession, d: str) -> DataFrame:
    """Fit on all documents, score all of them."""
    docs = table(spark, d, "documents")
    model = models.discover(docs, "doc_id", "text", "tfidf", 5)
    return model.transform(docs, "doc_id", "text").select("id", "topic_id", "probability")


@query("tm_unified")
def tm_unified(spark: SparkSession, d: str) -> DataFrame:
    docs, out = table(spark, d, "documents"), None
    for method in ("tfidf", "simple_kmeans", "lsa"):
        one = models.discover(docs, "doc_id", "text", method, 4).info().select(F.lit(method).alias("method"), "topic", "name", "size")
        out = one if out is None else out.unionByName(one)
    return out


@query("cl_wrap")
def cl_wrap(spark: SparkSession, d: str) -> DataFrame:
    """Fit and transform of each clustering, by size."""
    v, out = table(spark, d, "embeddings"), None
    for name, got in (("kmeans", models.kmeans_assign(v, "vec_id", "embedding", 6)[0].withColumnRenamed("vec_id", "id")), ("hdbscan", models.fit_density(v, "vec_id", "embedding", 10, 5)), ("agglomerative", models.fit_agglomerative(v, "vec_id", "embedding", 6))):
        one = got.groupBy("topic_id").agg(F.count("*").alias("size")).select(F.lit(name).alias("algorithm"), F.when(F.col("topic_id") < 0, "Noise").otherwise(F.concat(F.lit("Topic_"), "topic_id")).alias("topic"), "size")
        out = one if out is None else out.unionByName(one)
    return out


@query("agg_lda_topics", f"with {M._PROBS}, b as (select list_position(p, list_max(p)) - 1 as topic from probs) select cast(topic as integer) as topic, count(*) as count from b group by 1")
def agg_lda_topics(spark: SparkSession, d: str) -> DataFrame:
    return models.topic_counts(M._probs(spark, d), "p")


@query("agg_lda_topics_compat", f"with {M._PROBS}, b as (select list_position(list_transform(p, lambda x: x >= 0.11), true) - 1 as topic from probs where list_max(p) >= 0.11) select cast(topic as bigint) as topic, count(*) as count from b group by 1")
def agg_lda_topics_compat(spark: SparkSession, d: str) -> DataFrame:
    """The first topic with a share of at least 0.11 instead of the largest."""
    return models.topic_counts(M._probs(spark, d), "p", 0.11, compat=True)


@query("emb_precision", "select vec_id, len(embedding) * 2 as bytes, true as near from embeddings")
def emb_precision(spark: SparkSession, d: str) -> DataFrame:
    """Vectors kept in half precision, half the space; every entry comes back within half a unit in the last of its eleven bits."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    halved = Z.to_half(e, "vec_id", "embedding")
    back = Z.from_half(halved, "vec_id", "half").withColumnRenamed("embedding", "back")
    near = F.forall(F.zip_with("embedding", "back", lambda a, b: F.abs(a - b) <= F.abs(a) * 2.0**-11 + 2.0**-25), lambda x: x)
    return e.join(halved, "vec_id").join(back, "vec_id").select("vec_id", F.length("half").cast("bigint").alias("bytes"), near.alias("near"))


@query("fb_setup", "select doc_id, 'random' as reason from documents order by md5('42:' || cast(doc_id as varchar)), doc_id limit 30")
def fb_setup(spark: SparkSession, d: str) -> DataFrame:
    """What to review where no model has given probabilities yet: a random choice."""
    return feedback.to_review(table(spark, d, "documents"), "doc_id", 30)


@query("fb_setup_model", "select 30 as documents, 21 as uncertain")
def fb_setup_model(spark: SparkSession, d: str) -> DataFrame:
    """With probabilities and vectors: uncertain documents first, the rest unlike each other."""
    both = M._probs(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    return feedback.to_review(both, "id", 30, "p", "embedding").agg(F.count_distinct("id").alias("documents"), F.count_if(F.col("reason") == "uncertain").alias("uncertain"))


@query("fb_update", """with last as (select doc_id, corrected_topic from feedback_log where doc_id is not null qualify row_number() over (partition by doc_id order by logged_at desc, corrected_topic desc nulls last) = 1), docs as (select distinct doc_id, topic from sample_documents),
now as (select coalesce(corrected_topic, topic) as topic from docs left join last using (doc_id)) select topic, count(*) as documents from now where topic is not null group by 1""")
def fb_update(spark: SparkSession, d: str) -> DataFrame:
    """One turn of the loop: feedback applied, topic vectors learnt again from the texts as they are now labelled."""
    docs = table(spark, d, "sample_documents").groupBy("doc_id", "topic").agg(F.min("text").alias("text"))
    new = feedback.apply_feedback(docs, "doc_id", "topic", table(spark, d, "feedback_log"), "corrected_topic", "logged_at")
    return feedback.refit(Z.embed(new, "doc_id", "text", keep=("current_topic",)), "current_topic", "embedding").select(F.col("group").alias("topic"), F.col("n").alias("documents"))


# sources, sinks, configuration: files of the driver
def _folder(spark: SparkSession) -> Path:
    """A folder for the driver's own small files: in the shared folder where that is mounted."""
    shared = shared_dir(spark)
    path = shared.removeprefix("file://") if shared.startswith("file://") else shared.removeprefix("file:")
    return Path(tempfile.mkdtemp(prefix="corpusmith-", dir=path if Path(path).is_dir() else None))


@query("src_iter", "select doc_id, text from documents")
def src_iter(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a Python iterator yields, written in batches; a batch that is already there isn't written again."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), work_path(spark, "iterated")
    readers.from_iterator(spark, map(tuple, docs.limit(10).toLocalIterator()), docs.schema, path, 4)  # a first run that was cut short
    return readers.from_iterator(spark, map(tuple, docs.toLocalIterator(prefetchPartitions=True)), docs.schema, path, 5000, restart=True)


@query("src_team", SQL["team_ops"])
def src_team(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "team_terms")
    path = str(_folder(spark) / "team.json")
    D.TeamConfig("claims", D.as_dict(D.clean_terms(t, "acronym")), D.as_dict(D.clean_terms(t, "correction"))).save(path)
    return D.TeamConfig.load(path).to_table(spark)


_same("snk_team", "src_team")


@query("team_contract", "select 'acronyms' as part, count(*) as entries from (" + X._CLEAN.format("acronym") + ") union all select 'corrections', count(*) from (" + X._CLEAN.format("correction") + ")")
def team_contract(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "team_terms")
    stats = D.TeamConfig("claims").update(D.as_dict(D.clean_terms(t, "acronym")), D.as_dict(D.clean_terms(t, "correction"))).stats()
    return spark.createDataFrame([(k, stats[k]) for k in ("acronyms", "corrections")], "part string, entries long")


@query("src_config", "select * from (values ('embedding_cluster', 10, 0.4)) v(method, num_topics, threshold)")
def src_config(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark) / "config.json"
    path.write_text(json.dumps({"matching": {"threshold": 0.4}}))
    c = config.load(str(path))
    return spark.createDataFrame([(c.workflow.method, c.workflow.num_topics, c.matching.threshold)], "method string, num_topics int, threshold double")


@query("snk_config", X._CLEAN.format("acronym"))
def snk_config(spark: SparkSession, d: str) -> DataFrame:
    """A configuration with the team's acronyms, written and read back."""
    path = str(_folder(spark) / "config.json")
    config.save(config.Config.from_dict({"acronyms": {"mappings": D.as_dict(D.clean_terms(table(spark, d, "team_terms"), "acronym"))}}), path)
    return spark.createDataFrame(sorted(config.load(path).acronyms.mappings.items()), "term string, replacement string")


@query("snk_json", "select topic as name, count(*) as count, round(count(*) / sum(count(*)) over (), 6) as share from sample_documents where topic is not null group by 1")
def snk_json(spark: SparkSession, d: str) -> DataFrame:
    report = json.loads(writers.json_report(series.topic_report(table(spark, d, "sample_documents"), "doc_id", "text", "topic")))
    return spark.createDataFrame([(t["name"], t["count"], round(report["distribution"][t["name"]], 6)) for t in report["topics"]], "name string, count long, share double")


@query("snk_html", "select topic as name, cast(count(*) as varchar) as count from sample_documents where topic is not null group by 1")
def snk_html(spark: SparkSession, d: str) -> DataFrame:
    """The topics' rows as they stand in the page."""
    import re

    docs = table(spark, d, "sample_documents")
    page = writers.html_report(series.topic_report(docs, "doc_id", "text", "topic"), None, prepare.corpus_statistics(docs, "text"))
    return spark.createDataFrame(re.findall(r"<tr><td>([^<]+)</td><td>(\d+)</td><td>[^<]*</td></tr>", page), "name string, count string")


@query("snk_acr_html", f"select acronym, count(*) as count from (select unnest({X._ACRONYMS}) as acronym from documents) group by 1 having count(*) >= 2 order by 2 desc, 1 limit 30")
def snk_acr_html(spark: SparkSession, d: str) -> DataFrame:
    import re

    docs = table(spark, d, "documents")
    found = prepare.detect_acronyms(docs, "text", limit=30)
    near = prepare.suggest(found, "acronym", D.clean_terms(table(spark, d, "team_terms"), "acronym"), "term", "replacement")
    page = writers.word_report(found, near, prepare.contexts(docs, "doc_id", "text", found, "acronym"), "acronym")
    return spark.createDataFrame([(re.sub("&amp;", "&", a), int(n)) for a, n in re.findall(r"<tr><td>([^<]+)</td><td>(\d+)</td>", page)], "acronym string, count long")


@query("snk_spell_html", SQL["spell_detect"].replace("select fixed.word, words.count, correction,", "select fixed.word, words.count from fixed join words using (word) where correction <> fixed.word --"))
def snk_spell_html(spark: SparkSession, d: str) -> DataFrame:
    import re

    docs = table(spark, d, "sample_documents")
    found = prepare.detect_misspellings(docs, "text", D.as_dict(D.clean_terms(table(spark, d, "team_terms"), "correction")))
    near = found.select("word", F.col("correction").alias("value"), F.col("ratio").alias("score"), F.lit(1).alias("rank"))
    page = writers.word_report(found, near, prepare.contexts(docs, "doc_id", "text", found, "word", r"\p{L}+", ignore_case=True), "word", title="Misspellings")
    return spark.createDataFrame([(a, int(n)) for a, n in re.findall(r"<tr><td>([^<]+)</td><td>(\d+)</td>", page)], "word string, count long")


@query("cfg_model", SQL["team_contract"])
def cfg_model(spark: SparkSession, d: str) -> DataFrame:
    """The team's dictionaries as sections of the configuration."""
    t = table(spark, d, "team_terms")
    c = config.Config.from_dict({"acronyms": {"mappings": D.as_dict(D.clean_terms(t, "acronym"))}, "spelling": {"corrections": D.as_dict(D.clean_terms(t, "correction"))}}).to_dict()
    return spark.createDataFrame([("acronyms", len(c["acronyms"]["mappings"])), ("corrections", len(c["spelling"]["corrections"]))], "part string, entries long")


@query("cfg_validate", "select distinct term as refused from team_terms where term is not null")
def cfg_validate(spark: SparkSession, d: str) -> DataFrame:
    """None of the team's terms is the name of a method, so each is refused as one."""
    refused = []
    for r in table(spark, d, "team_terms").where("term is not null").select("term").distinct().collect():  # a small table
        try:
            config.Config.from_dict({"workflow": {"method": r.term}})
        except ValueError:
            refused.append((r.term,))
    return spark.createDataFrame(refused, "refused string")


@query("cfg_merge", "select * from (values ('nmf', 7)) v(method, num_topics)")
def cfg_merge(spark: SparkSession, d: str) -> DataFrame:
    c = config.load(overrides=config.merge({"workflow": {"method": "nmf", "num_topics": 3}}, {"workflow": {"num_topics": 7}}))
    return spark.createDataFrame([(c.workflow.method, c.workflow.num_topics)], "method string, num_topics int")


@query("cli_config", SQL["team_contract"])
def cli_config(spark: SparkSession, d: str) -> DataFrame:
    """Dictionaries through the command line: exported as JSON, created, read back."""
    from corpusmith import cli

    t, folder = table(spark, d, "team_terms"), _folder(spark)
    for part, kind in (("acronyms", "acronym"), ("corrections", "correction")):
        (folder / f"{part}.json").write_text(json.dumps(D.as_dict(D.clean_terms(t, kind))))
    cli.main(["create", str(folder / "team.json"), "--acronyms", str(folder / "acronyms.json"), "--corrections", str(folder / "corrections.json")])
    stats = D.TeamConfig.load(str(folder / "team.json")).stats()
    return spark.createDataFrame([(k, stats[k]) for k in ("acronyms", "corrections")], "part string, entries long")


# extension points
@query("udf_encoder", "select doc_id, cast(length(coalesce(text, '')) as double) as chars, cast(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) as double) as blanks from documents")
def udf_encoder(spark: SparkSession, d: str) -> DataFrame:
    """An encoder of one's own: Arrow batches of texts in, a matrix out."""

    def encode(texts: pd.Series) -> np.ndarray:
        return np.stack([texts.str.len(), texts.str.count(" ")], axis=1)

    return Z.embed(table(spark, d, "documents"), "doc_id", "text", encode).select("doc_id", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("blanks"))


@query("udf_filter", "select doc_id as id, text from documents where category = 'Home' and n_chars < 1000")
def udf_filter(spark: SparkSession, d: str) -> DataFrame:
    return readers.scan(spark, f"{d}/documents.parquet", "text", "doc_id", lambda df: df.where("category = 'Home' and n_chars < 1000"))


@query("udf_scorer")
def udf_scorer(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = models.search_parameters(lambda **p: models.discover(docs, "doc_id", "text", "tfidf", **p), {"num_topics": [3, 5]}, how="progressive", scorer=lambda m: -float(m.info().count()))
    return spark.createDataFrame([(str(r["params"]), r["score"]) for r in found], "params string, score double")


_same("udf_grid", "opt_search")


@query("udf_callback", "select unnest(['expand_acronyms', 'correct_spelling', 'preprocess']) as stage, (select count(*) from sample_documents) as documents, (select count(*) from sample_documents where text is not null) as texts")
def udf_callback(spark: SparkSession, d: str) -> DataFrame:
    """A function of one's own that the workflow tells about every stage and its table."""
    told: list[tuple[str, int, int]] = []
    flow = Workflow.start(table(spark, d, "sample_documents"), told=lambda stage, df: told.append((stage, *df.agg(F.count("*"), F.count("text")).first())))
    fix = {k: D.as_dict(D.clean_terms(table(spark, d, "team_terms"), k)) for k in ("acronym", "correction")}
    flow.expand_acronyms(fix["acronym"]).correct_spelling(fix["correction"]).preprocess()
    # null texts count as empty once a stage has read them
    empty = table(spark, d, "sample_documents").where("text is null").count()
    return spark.createDataFrame([(s, n, k - empty) for s, n, k in told], "stage string, documents long, texts long")


@query("udf_template", "select 'own: ' || cast(count(distinct topic) as varchar) as page from sample_documents where topic is not null")
def udf_template(spark: SparkSession, d: str) -> DataFrame:
    page = writers.html_report(series.topic_report(table(spark, d, "sample_documents"), "doc_id", "text", "topic"), template="own:{body}")
    return spark.createDataFrame([(f"own: {page.count('<h2>')}",)], "page string")


# streaming
def _embedded(spark: SparkSession, d: str) -> tuple[str, dict[str, object]]:
    out = work_path(spark, "stream")
    q = jobs.to_table(jobs.embed_stream(M._stream(spark, d, "documents"), "doc_id", "text"), out, work_path(spark, "check"))
    q.awaitTermination()
    return out, jobs.progress(q)


@query("st_fit")
def st_fit(spark: SparkSession, d: str) -> DataFrame:
    out, _ = _embedded(spark, d)
    return models.kmeans_assign(spark.read.parquet(out), "doc_id", "embedding", 5)[0].drop("probabilities")


@query("st_process", "select count(*) as documents, 64 as dim, 5 as topics, true as timed from documents")
def st_process(spark: SparkSession, d: str) -> DataFrame:
    """A stream of files end to end: embedded, fitted, labelled, with its counters."""
    out, told = _embedded(spark, d)
    labelled = models.kmeans_assign(spark.read.parquet(out), "doc_id", "embedding", 5)[0].join(spark.read.parquet(out), "doc_id")
    return labelled.agg(F.count_distinct("doc_id").alias("documents"), F.max(F.size("embedding")).alias("dim"), F.count_distinct("topic_id").alias("topics"), F.lit(told["batches"] > 0 and told["ms"] > 0).alias("timed"))


@query("st_stats", "select count(*) as rows, true as batches from documents")
def st_stats(spark: SparkSession, d: str) -> DataFrame:
    told = _embedded(spark, d)[1]
    return spark.createDataFrame([(int(told["rows"]), told["batches"] >= 1)], "rows long, batches boolean")


@query("st_genfile", "select doc_id, 64 as dim from documents where doc_id is not null")
def st_genfile(spark: SparkSession, d: str) -> DataFrame:
    """CSV files that are streamed through the encoder."""
    folder, out = work_path(spark, "files"), work_path(spark, "stream")
    table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text")).write.options(header="true", escape='"').csv(folder)
    jobs.to_table(jobs.embed_stream(readers.stream(spark, folder, "doc_id bigint, text string", "csv", 4), "doc_id", "text"), out, work_path(spark, "check")).awaitTermination()
    return spark.read.parquet(out).select("doc_id", F.size("embedding").alias("dim"))


@query("st_clean", "select count(*) as documents, 0 as left_over from documents")
def st_clean(spark: SparkSession, d: str) -> DataFrame:
    """The output and checkpoint of a finished stream removed; how much there was and what is left of it."""
    out, _ = _embedded(spark, d)
    documents = spark.read.parquet(out).count()
    jobs.clean(spark, out)
    return spark.createDataFrame([(documents, int(jobs.exists(spark, out)))], "documents long, left_over int")


@query("wf_viz", S._grid("last_day(obs_ts)", top=10) + " select * from filled")
def wf_viz(spark: SparkSession, d: str) -> DataFrame:
    """The table behind a trend chart, through the workflow."""
    flow = Workflow.start(table(spark, d, "topic_activity").withColumn("text", F.col("topic")), id="obs_id", time="obs_ts")
    return S._day(flow.trends("M"))


