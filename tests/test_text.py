import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmith.functions import text as T
from corpusmith.operators import prepare


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_normalize_steps(spark):
    assert one(spark, "The 3 Claims, were PAID!", T.normalize(F.col("t"), lemmatize=False)) == "3 claims paid"
    assert one(spark, "The 3 Claims", T.normalize(F.col("t"), remove_numbers=True, lemmatize=False)) == "claims"
    assert one(spark, "The Claims", T.normalize(F.col("t"), lowercase=False, lemmatize=False)) == "Claims"
    assert one(spark, "the claims", T.normalize(F.col("t"), lemmatize=False, keep=("the",), custom=("claims",))) == "the"
    assert one(spark, None, T.normalize(F.col("t"))) == ""


@pytest.mark.parametrize(("word", "base"), [("policies", "policy"), ("losses", "loss"), ("moving", "mov"), ("repaired", "repair"), ("claims", "claim"), ("bus", "bus"), ("was", "be"), ("glass", "glass")])
def test_lemma(spark, word, base):
    assert one(spark, word, T.lemma(F.col("t"))) == base


def test_acronyms(spark):
    assert one(spark, "The CEO and the P&L of ITEMS; A and x", T.acronyms(F.col("t"))) == ["CEO", "P&L", "ITEMS"]
    assert one(spark, "IT for ITEMS and IT", prepare.expand_acronyms(F.col("t"), {"IT": "Tech"})) == "IT (Tech) for ITEMS and IT (Tech)"
    nested = one(spark, "IT ITEMS IT", prepare.expand_acronyms(F.col("t"), {"IT": "Tech"}, compat=True))
    assert nested == "IT (Tech) (Tech) IT (Tech) (Tech)EMS IT (Tech) (Tech)"


def test_spelling(spark):
    fix = {"vehical": "vehicle", "recieved": "received"}
    assert one(spark, "Vehical recieved, vehicl ok.", prepare.correct_text(F.col("t"), fix)) == "vehicle received, vehicle ok."
    assert one(spark, "cat", prepare.correct_text(F.col("t"), fix)) == "cat"
    assert one(spark, None, prepare.correct_text(F.col("t"), fix)) == ""


def test_texts_and_words_agree(spark):
    fix = {"vehical": "vehicle", "recieved": "received"}
    df = spark.createDataFrame([("Vehical recieved, VEHICL ok.",), (None,), ("cat",)], "t string")
    want = [r.x for r in df.select(prepare.correct_text(F.col("t"), fix).alias("x")).collect()]
    for limit in (500, 1):
        assert [r.t for r in prepare.correct_texts(df, "t", fix, limit).collect()] == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert prepare.acronym_counts(empty, "text").count() == 0
    assert prepare.corpus_statistics(empty, "text").first().documents == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_normalized_is_clean(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize(F.col("t"), lemmatize=False).alias("x")).collect()
    for r in rows:
        assert r.x == r.x.lower() or any(ord(c) > 127 for c in r.x)
        assert not set(r.x) & set(".,;:!?\"'()")


def test_many_acronyms_are_sent_and_few_stand_in_the_plan(spark):
    known = {f"A{i}": f"word {i}" for i in range(1200)} | {"P&L": "Profit and Loss"}
    df = spark.createDataFrame([(1, "A7 for A77, A7x and P&L (A1199)."), (2, None), (3, "")], "id long, t string")
    few = {k: known[k] for k in ("A7", "A77", "P&L", "A1199")}
    got = [{r.id: r.t for r in prepare.expand_texts(df, "t", m).collect()} for m in (known, few)]
    assert got[0] == got[1] and got[0][1] == "A7 (word 7) for A77 (word 77), A7x and P&L (Profit and Loss) (A1199 (word 1199))."


def test_doubled_consonants(spark):
    for word, base in (("running", "run"), ("planned", "plan"), ("adding", "add"), ("falling", "fall"), ("missed", "miss"), ("towing", "tow")):
        assert one(spark, word, T.lemma(F.col("t"))) == base
