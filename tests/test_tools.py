import json

import pytest
from pyspark.sql import functions as F

from corpusmith import cli, config, dictionaries
from corpusmith.functions import text as T
from corpusmith.operators import prepare, series
from corpusmith.plans.pipeline import Workflow
from corpusmith.session import shared_dir, spread
from corpusmith.sources import readers, writers


def test_config():
    c = config.load(overrides={"matching": {"threshold": 0.3}, "workflow": {"method": "nmf"}})
    assert c.matching.threshold == 0.3 and c.workflow.num_topics == 10
    with pytest.raises(ValueError):
        config.Config.from_dict({"embeddings": {"precision": "float8"}})
    with pytest.raises(ValueError):
        config.Config.from_dict({"lda": {"nope": 1}})
    assert config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_config_file(tmp_path):
    p = str(tmp_path / "c.json")
    config.save(config.Config(), p)
    assert config.load(p) == config.Config()


def test_team(tmp_path):
    a = dictionaries.TeamConfig("x").add_acronym("PH", "Policyholder").add_correction("polcy", "policy")
    b = dictionaries.TeamConfig("y", {"PH": "Other", "UW": "Underwriting"})
    assert a.merged(b).acronyms == {"PH": "Other", "UW": "Underwriting"}
    assert a.differences(b)["acronyms"]["different"] == {"PH": ("Policyholder", "Other")}
    a.save(str(tmp_path / "t.json"))
    assert dictionaries.TeamConfig.load(str(tmp_path / "t.json")) == a


def test_cli(tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps({"BI": "Bodily Injury"}))
    t = str(tmp_path / "t.json")
    assert cli.main(["create", t, "--acronyms", str(tmp_path / "a.json")]) == 0
    assert cli.main(["stats", t]) == 0 and json.loads(capsys.readouterr().out)["acronyms"] == 1
    assert cli.main(["merge", t, t, str(tmp_path / "m.json")]) == 0
    assert cli.main(["export-acronyms", t, str(tmp_path / "e.json")]) == 0
    assert cli.main(["stats", str(tmp_path / "none.json")]) == 1


def test_readers(spark, tmp_path):
    (tmp_path / "x.csv").write_text('text,id,category\n"a, ""b""\nc",1,k\n,2,k\n')
    df = readers.load(str(tmp_path / "x.csv"), readers.CorpusSpec("text", "id", category="category"), spark)
    assert sorted((r.id, r.text) for r in df.collect()) == [(1, 'a, "b"\nc'), (2, None)]
    with pytest.raises(ValueError):
        readers.load(df, readers.CorpusSpec("body"))
    assert readers.scan(spark, str(tmp_path / "x.csv"), "text", "id", lambda d: d.where("id = 1")).count() == 1
    (tmp_path / "y.txt").write_text("one\n\n  \ntwo\n")
    assert sorted(r.text for r in readers.upload(spark, str(tmp_path / "y.txt")).collect()) == ["one", "two"]
    assert sorted(r.doc_id for r in readers.with_ids(df, "id").collect()) == ["doc_0", "doc_1"]


def test_reports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a <b>", "T"), (2, "c", "T"), (3, "d", "U"), (4, "e", None)], "doc_id long, text string, topic string")
    told = series.topic_report(docs, "doc_id", "text", "topic")
    page = writers.html_report(told, path=str(tmp_path / "r.html"))
    assert "a &lt;b&gt;" in page
    assert json.loads(writers.json_report(told))["topics"][0] == {"name": "T", "count": 2, "examples": ["a <b>", "c"]}
    out = writers.export(docs, str(tmp_path / "e"), ("csv", "json", "parquet"))
    assert spark.read.options(header="true", escape='"').csv(out["csv"]).count() == 4
    with pytest.raises(ValueError):
        writers.export(docs, str(tmp_path), ("tape",))
    writers.export_feedback(docs.withColumnRenamed("topic", "o").selectExpr("doc_id", "o", "'T' as c"), str(tmp_path / "f"), "o", "c")
    back = writers.import_feedback(docs, "doc_id", str(tmp_path / "f"), "c")
    assert back.where("c = 'T'").count() == 4


def test_series_choices(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3)], "region string, topic string, v int")
    with pytest.raises(ValueError):
        series.regions(df, "region", "topic", "sum")
    assert series.regions(df, "region", "topic", "median", "v").count() == 2


def test_workflow(spark):
    docs = spark.createDataFrame([(i, f"PH reports water leak {i}" if i % 2 else f"car crash tow {i}") for i in range(20)], "doc_id long, text string")
    flow = Workflow.start(docs).run({"PH": "Policyholder"}, method="tfidf", num_topics=2)
    assert flow.documents.where("topic is not null").count() == 20
    assert "Policyholder" in flow.documents.where("doc_id = 1").first().text
    assert "<html" in flow.report()
    assert Workflow.start(docs).match({"Water": "water leak", "Cars": "car crash"}, 0.1).count() == 20


def test_numbers_go_on_over_partitions(spark):
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 7919 % 500).alias("id"))
    got = {r.id: r.doc_id for r in readers.with_ids(df, "id").collect()}
    assert got == {i: f"doc_{i}" for i in range(500)}


def test_rows_of_an_iterator(spark, tmp_path):
    rows, path = [(i, f"t{i}") for i in range(25)], str(tmp_path / "it")
    for _ in range(2):  # the second time the batches are there
        assert {tuple(r) for r in readers.from_iterator(spark, iter(rows), "id long, t string", path, 10).select("id", "t").collect()} == set(rows)
    assert readers.from_iterator(spark, iter([]), "id long, t string", path + "2").count() == 0


def test_suggestions_lose_nothing(spark):
    words = ["abc", "claim", "claims", "clam", "policy", "polcy", "x", "underwriting", "underwritng", "abcd"]
    known = spark.createDataFrame([(w, w.upper()) for w in words[::-1]], "k string, v string")
    asked = spark.createDataFrame([(w,) for w in [*words, None, "clai", "pol"]], "w string")
    got = {(r.word, r.suggestion) for r in prepare.suggest(asked, "w", known, "k", "v", 60.0, 100).collect()}
    every = asked.where("w is not null").crossJoin(known).withColumn("s", T.similarity(F.col("w"), F.col("k"))).where("s >= 60")
    assert got == {(r.w, r.k) for r in every.collect()}


def test_small_inputs_are_spread_without_a_job(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_missing_shared_folder_is_refused_on_a_cluster():
    class Cluster:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    with pytest.raises(ValueError):
        shared_dir(type("S", (), {"sparkContext": Cluster()})())
