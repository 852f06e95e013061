import numpy as np
import pytest

from corpusmith.operators import compare, feedback, matching, models
from corpusmith.operators import vectorize as Z


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(c * 40 + i, [float(x) for x in np.eye(3)[c] * 5 + rng.standard_normal(3) * 0.2], f"c{c}") for c in range(3) for i in range(40)]
    return spark.createDataFrame(rows, "id long, v array<double>, label string")


@pytest.fixture(scope="module")
def docs(spark):
    kinds = ["burst pipe flooded kitchen water damage plumber", "rear collision vehicle bumper tow truck driver", "flight cancelled luggage airport trip refund"]
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, " ".join(rng.choice(kinds[i % 3].split(), 12))) for i in range(90)], "doc_id long, text string")


def agree(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(i, set()).add(t)
    return all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_kmeans_finds_blobs(blobs):
    got, centers = models.kmeans_assign(blobs, "id", "v", 3)
    assert agree([(r.id // 40, r.topic_id) for r in got.collect()])
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in got.limit(5).collect())


def test_density_and_ward(blobs):
    assert agree([(r.id // 40, r.topic_id) for r in models.fit_density(blobs, "id", "v", 10, 5).collect() if r.topic_id >= 0])
    assert agree([(r.id // 40, r.topic_id) for r in models.fit_agglomerative(blobs, "id", "v", 3, 12).collect()])


def test_density_beyond_the_limit_is_exact(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in [(0, 0.3, 300), (4, 0.1, 40), (4.8, 0.1, 30)]] + [rng.uniform(-3, 8, (230, 3)), np.zeros((20, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    one, other = ({r.id: r.topic_id for r in models.fit_density(df, "id", "v", 15, 5, limit=limit).collect()} for limit in (1000, 100))
    assert one == other and len(set(one.values())) > 2
    a, b = models.mutual_tree(x, 5), models.mutual_tree_by_leaves(spark, x, 5, 32)
    assert np.allclose(sorted(e[0] for e in a), sorted(e[0] for e in b), atol=1e-6)


def test_density_of_nothing_and_little(spark):
    assert models.fit_density(spark.createDataFrame([], "id long, v array<double>"), "id", "v").count() == 0
    assert {r.topic_id for r in models.fit_density(spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, v array<double>"), "id", "v").collect()} == {-1}


@pytest.mark.parametrize("method", ["tfidf", "nmf", "simple_kmeans", "lsa"])
def test_text_models(docs, method):
    model = models.discover(docs, "doc_id", "text", method, 3)
    info = model.info().collect()
    assert sum(r.size for r in info) == 90
    assert all(r.words and r.name for r in info)
    if method in ("tfidf", "nmf"):
        assert agree([(r.id % 3, r.topic_id) for r in model.assigned.collect()])
    scored = model.transform(docs, "doc_id", "text")
    assert scored.count() == 90


def test_lsa_is_the_svd(docs):
    model = models.fit_lsa(docs, "doc_id", "text", 3)
    weights, vocab = Z.fit_tfidf(docs, "doc_id", "text")
    x = np.zeros((90, vocab.count()))
    for r in weights.collect():
        x[r.id, r.idx] = r.weight
    assert np.allclose(model.extra["singular_values"], np.linalg.svd(x)[1][:3], atol=1e-3)


def test_nmf_fits(docs):
    model = models.fit_nmf(docs, "doc_id", "text", 3)
    assert (model.components >= 0).all() and model.extra["loss"] < 90 * 0.5


def test_save_and_load(spark, docs, tmp_path):
    model = models.discover(docs, "doc_id", "text", "tfidf", 3)
    model.save(str(tmp_path / "m"))
    back = models.TopicModel.load(spark, str(tmp_path / "m"))
    key = lambda m: sorted((r.id, r.topic_id) for r in m.transform(docs, "doc_id", "text").collect())
    assert key(back) == key(model)


def test_unknown_method(docs):
    with pytest.raises(ValueError):
        models.discover(docs, "doc_id", "text", "magic")


def test_matching(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7]), (4, [0.0, 0.0])], "id long, v array<double>")
    topics = [("Technology", [1.0, 0.0]), ("Sports", [0.0, 2.0])]
    assert {(r.id, r.topic): r.score for r in matching.similarities(df, "id", "v", topics).collect()}[2, "Sports"] == 1.0
    assert {r.id: r.primary_topic for r in matching.match_one(df, "id", "v", topics, 0.9).collect()} == {1: "Technology", 2: "Sports", 3: "Unknown", 4: "Unknown"}
    many = {r.id: (r.all_topics, r.all_scores) for r in matching.match_many(df, "id", "v", topics, 0.6, 2).collect()}
    assert set(many[3][0]) == {"Technology", "Sports"} and many[4] == (["Unknown"], [0.0])


def test_classifier(blobs):
    model = matching.fit_classifier(blobs, "label", "v", "logistic")
    got = matching.classify(model, blobs, "id", "v").collect()
    assert all(r.label == f"c{r.id // 40}" for r in got)


def test_mmr_merge_and_metrics(spark):
    terms = ["a", "b", "c"]
    assert models.maximal_marginal_relevance(np.array([1.0, 0]), np.array([[1.0, 0], [0.99, 0.01], [0, 1.0]]), terms, 2, 0.9) == ["a", "c"]
    assert list(models.merge_smallest(np.array([[1.0, 0], [0.9, 0.1], [0, 1.0]]), np.array([5, 1, 5]), 2)) == [0, 0, 1]
    words = spark.createDataFrame([(0, "a", 1.0, 1), (0, "b", 0.5, 2), (1, "b", 1.0, 1), (1, "c", 0.5, 2)], "topic int, term string, weight double, rank int")
    m = models.model_metrics(words, spark.createDataFrame([(1, 0), (2, -1)], "id long, topic_id int"))
    assert m["n_topics"] == 2 and abs(m["diversity"] - 2 / 3) < 1e-9 and m["outliers"] == 50
    assert compare.jaccard(words).first().similarity == pytest.approx(1 / 3, abs=1e-6)


def test_feedback_choices(spark):
    df = spark.createDataFrame([(i, [0.5 + i / 100, 0.5 - i / 100], [float(i % 2) * 9, float(i)]) for i in range(20)], "id long, p array<double>, v array<double>")
    assert [r.id for r in feedback.uncertain(df, "id", "p", 3).collect()] == [0, 1, 2]
    both = feedback.combined(df, "id", "p", "v", 6, 0.5).collect()
    assert len({r.id for r in both}) == 6


def test_embed_cache(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b cc"), (2, None), (3, "a b cc")], "doc_id long, text string")
    for _ in range(2):
        got = {r.doc_id: list(r.embedding) for r in Z.embed_cached(docs, "doc_id", "text", str(tmp_path / "c")).collect()}
        assert got[1] == got[3] and not any(got[2])
    assert Z.cache_info(str(tmp_path / "c"), spark)["entries"] == 2


def test_tm_base_scores_every_document(spark, data):
    from corpusmith.plans.more_queries import tm_base

    ids = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select("doc_id").collect()}
    assert ids <= {r.id for r in tm_base(spark, data).select("id").collect()}


def test_ward_is_greedy_and_exact(blobs):
    rng = np.random.default_rng(2)
    x, n = rng.standard_normal((30, 3)), rng.integers(1, 5, 30).astype(float)
    groups, c, w = [[i] for i in range(30)], list(x), list(n)
    while len(groups) > 6:
        cost = {(i, j): ((c[i] - c[j]) ** 2).sum() * w[i] * w[j] / (w[i] + w[j]) for i in range(len(c)) for j in range(i + 1, len(c))}
        i, j = min(cost, key=cost.get)
        c[i], w[i], groups[i] = (c[i] * w[i] + c[j] * w[j]) / (w[i] + w[j]), w[i] + w[j], groups[i] + groups[j]
        del c[j], w[j], groups[j]
    got = models.ward(x, n, 6)
    assert sorted(map(sorted, groups)) == sorted(sorted(np.flatnonzero(got == g).tolist()) for g in range(6))
    one, other = ({r.id: r.topic_id for r in models.fit_agglomerative(blobs, "id", "v", 3, 12, exact=e).collect()} for e in (2000, 10))
    assert one == other


def test_sparse_rows_are_the_columns_weights(docs):
    weights, vocab = Z.fit_tfidf(docs, "doc_id", "text")
    want = {}
    for r in weights.collect():
        want.setdefault(r.id, {})[r.idx] = r.weight
    got = {r.id: dict(zip(np.frombuffer(r.idx, np.int32).tolist(), np.frombuffer(r.w, np.float32).tolist(), strict=True)) for r in Z.sparse_rows(docs, "doc_id", "text", vocab).collect()}
    assert got.keys() == want.keys() and all(got[i].keys() == want[i].keys() and np.allclose([got[i][t] for t in want[i]], list(want[i].values()), atol=1e-6) for i in want)


def test_halves(spark):
    df = spark.createDataFrame([(1, [0.1, -2.5]), (2, None), (3, [])], "id long, v array<float>")
    back = {r.id: r.embedding for r in Z.from_half(Z.to_half(df, "id", "v"), "id", "half").collect()}
    assert np.allclose(back[1], [0.1, -2.5], rtol=2**-11) and back[2] is None and back[3] == []


def test_lda_tells_its_perplexity(docs):
    assert models.fit_lda(docs, "doc_id", "text", 3, 5).perplexity(docs, "doc_id", "text") > 0
    with pytest.raises(ValueError):
        models.discover(docs, "doc_id", "text", "tfidf", 3).perplexity(docs, "doc_id", "text")


def test_review_choices(spark):
    df = spark.createDataFrame([(i, [0.5 + i / 100, 0.5 - i / 100], [float(i % 2) * 9, float(i)]) for i in range(20)], "id long, p array<double>, v array<double>")
    assert [r.reason for r in feedback.to_review(df, "id", 4).collect()] == ["random"] * 4
    assert feedback.to_review(df, "id", 4).collect() == feedback.to_review(df.repartition(5), "id", 4).collect()
    assert {r.reason for r in feedback.to_review(df, "id", 6, "p", "v").collect()} == {"uncertain", "diverse"}
    assert [r.id for r in feedback.to_review(df, "id", 3, "p").collect()] == [0, 1, 2] and feedback.to_review(df, "id", 3, vec="v").count() == 3


def test_hierarchy_and_update(spark, docs):
    steps = models.hierarchy(spark, np.array([[1.0, 0], [0.9, 0.1], [0, 1.0]]), np.array([5, 1, 4])).orderBy("step").collect()
    assert [(r.left, r.right, r.merged, r.size) for r in steps] == [(0, 1, 3, 6), (3, 2, 4, 10)] and steps[0].distance < steps[1].distance
    model = models.discover(docs.where("doc_id < 60"), "doc_id", "text", "simple_kmeans", 3)
    new = models.update(model, docs, "doc_id", "text")
    assert agree([(r.id % 3, r.topic_id) for r in new.assigned.collect()]) and new.assigned.count() == 90
    assert not np.allclose(new.centers, model.centers) and np.abs(new.centers - model.centers).max() < 0.5
