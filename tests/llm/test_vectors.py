import numpy as np
import pytest

from corpusmith.llm import cells, clusters, knn
from corpusmith.llm.common import connected_components, unit
from corpusmith.llm.vectors import vector_table

DIM = 16


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, embedding array<float>, id int, v string, cell int")


def row(name, vec, extra=None):
    return (name, None if vec is None else [None if x is None else float(x) for x in vec], 1, "x", None)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, DIM)) * 3
    x = np.concatenate([c + rng.standard_normal((40, DIM)) for c in centers] + [rng.standard_normal((20, DIM))]).astype(np.float32)
    return {f"d{i}": v for i, v in enumerate(x)}


def brute(vectors, k):
    names = sorted(vectors)
    m = unit(np.array([vectors[n] for n in names]))
    s = m @ m.T
    out = {}
    for i, n in enumerate(names):
        order = sorted((j for j in range(len(names)) if j != i), key=lambda j: (-s[i, j], names[j]))[:k]
        out[n] = [names[j] for j in order]
    return out


@pytest.mark.parametrize(("cell_rows", "block"), [(1000, 32768), (60, 32768), (1000, 50), (80, 30)])
def test_neighbours_against_brute_force(spark, cloud, cell_rows, block):
    got = knn.most_similar(table(spark, [row(n, v) for n, v in cloud.items()]), "doc_id", "embedding", 5, DIM, cell_rows=cell_rows, block=block).collect()
    want, found = brute(cloud, 5), {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.rank, r.neighbour))
    hits = sum(len({n for _, n in found[d]} & set(w)) for d, w in want.items())
    assert hits / (5 * len(want)) > (0.999 if cell_rows == 1000 else 0.9)
    if cell_rows == 1000:
        assert all([n for _, n in sorted(found[d])] == w for d, w in want.items())


def test_unusable_repeated_and_equal_vectors(spark):
    e = np.eye(DIM)
    rows = [row("a", e[0]), row("a", e[0]), row("b", e[0] * 3), row("c", e[1]), row("n", None), row("s", [1.0]), row("z", e[0] * 0), row("nan", e[0] * float("nan")), row("hole", [None] * DIM), row(None, e[2])]
    rows += [row(f"same{i:02d}", e[1]) for i in range(20)]
    got = knn.most_similar(table(spark, rows), "doc_id", "embedding", 3, DIM).collect()
    near = {d: [r.neighbour for r in sorted(got, key=lambda r: r.rank) if r.doc_id == d] for d in {r.doc_id for r in got}}
    assert set(near) == {"a", "b", "c", *(f"same{i:02d}" for i in range(20))}
    assert near["a"][0] == "b" and near["b"][0] == "a"
    assert near["c"] == ["same00", "same01", "same02"]
    assert near["same19"] == ["c", "same00", "same01"] and near["same00"] == ["c", "same01", "same02"]


@pytest.mark.parametrize("rows", [[], [row("only", np.ones(DIM))], [row("n", None)]])
def test_too_few(spark, rows):
    df = table(spark, rows)
    assert knn.most_similar(df, "doc_id", "embedding", 5, DIM).count() == 0
    assert clusters.similarity_clusters(df, "doc_id", "embedding", dim=DIM).count() == 0


def chains_by_hand(vectors, least, size):
    names = sorted(vectors)
    m = unit(np.array([vectors[n] for n in names]))
    near, out, seen = m @ m.T >= least, {}, set()
    for i in range(len(names)):
        if i not in seen:
            stack, own = [i], {i}
            while stack:
                for j in np.flatnonzero(near[stack.pop()]):
                    if j not in own:
                        own.add(j)
                        stack.append(j)
            seen |= own
            if len(own) >= size:
                out.update({names[j]: names[min(own)] for j in own})
    return out


@pytest.mark.parametrize(("cell_rows", "block"), [(3000, 32768), (50, 32768), (3000, 60)])
def test_clusters_against_brute_force(spark, cloud, cell_rows, block):
    got = clusters.similarity_clusters(table(spark, [row(n, v) for n, v in cloud.items()]), "doc_id", "embedding", 0.75, 5, DIM, cell_rows=cell_rows, block=block)
    assert {r.doc_id: r.cluster for r in got.collect()} == chains_by_hand(cloud, 0.75, 5)


def test_equal_vectors_form_a_cluster(spark):
    e = np.eye(DIM)
    rows = [row(f"s{i}", e[0]) for i in range(5)] + [row("t", e[1]), row("u", e[2]), row("u", e[2])]
    got = clusters.similarity_clusters(table(spark, rows), "doc_id", "embedding", 0.9, 5, DIM)
    assert {(r.cluster, r.doc_id) for r in got.collect()} == {("s0", f"s{i}") for i in range(5)}


def test_description(spark):
    e = np.eye(DIM)
    rows = [row("a", e[0]), row("b", e[0] + e[1] * 0.1), row("c", e[0] + e[1] * 0.2)]
    members = spark.createDataFrame([("a", x) for x in "abc"], "cluster string, doc_id string")
    r = clusters.describe_clusters(members, table(spark, rows), "doc_id", "embedding", DIM, 2).first()
    assert (r.cluster, r.size, r.typical[0]) == ("a", 3, "b")


def test_text_vectors(spark):
    docs = spark.createDataFrame([("1", "water leak in the kitchen"), ("2", "Water leak, kitchen"), ("3", "car crash"), ("4", None), ("5", "  "), (None, "x")], "doc_id string, text string")
    got = {r.doc_id: np.array(r.embedding) for r in clusters.text_vectors(docs, "doc_id", "text", max_share=1.0).collect()}
    assert set(got) == set("12345") and not len(got["4"]) and not len(got["5"])
    assert got["1"] @ got["2"] > got["1"] @ got["3"]


def test_connected_components(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(30) if i != 10] + [("x", "x"), ("hub", "h0"), *((f"h{i}", "hub") for i in range(9))]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert {got[f"n{i}"] for i in range(11)} == {"n0"} and {got[f"n{i}"] for i in range(11, 31)} == {"n11"}
    assert {got[f"h{i}"] for i in range(9)} == {"h0"} == {got["hub"]} and "x" not in got


def test_kmeans_clusters(spark, cloud):
    got = clusters.kmeans_clusters(table(spark, [row(n, v) for n, v in cloud.items()] * 2), "doc_id", "embedding", 6, DIM).collect()
    assert sum(r.size for r in got) == len(cloud) and len(got) == 6 and all(1 <= len(r.typical) <= 3 for r in got)
    assert clusters.kmeans_clusters(table(spark, []), "doc_id", "embedding", 3, DIM).count() == 0
    few = clusters.kmeans_clusters(table(spark, [row("a", np.eye(DIM)[0]), row("b", np.eye(DIM)[0])]), "doc_id", "embedding", 3, DIM).collect()
    assert [(r.cluster, r.size, r.typical) for r in few] == [("a", 2, ["a", "b"])]


def test_codes_leave_few_rows_open(capsys):
    """Packed one-bit codes: share of pairs that are compared exactly, recall in the cell, and the time of a plain product for comparison."""
    import time

    rng = np.random.default_rng(5)
    topics = rng.standard_normal((50, 96)) * 1.7
    x = unit(np.repeat(topics, 60, 0) + rng.standard_normal((3000, 96)))
    center, turn, told = x.mean(0).astype(np.float32), knn.rotation(96, 512, 7), {}
    began = time.perf_counter()
    codes = knn.Codes.of(x.astype(np.float32), center, turn)
    at, value = knn.search(x, codes, x[:1000], np.arange(1000), 5, center, turn, 1.9, told=told)
    middle = time.perf_counter()
    s = x[:1000].astype(np.float32) @ x.astype(np.float32).T
    s[np.arange(1000), np.arange(1000)] = -2
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    end = time.perf_counter()
    recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(at.tolist(), want.tolist(), strict=True)])
    with capsys.disabled():
        print(f"open pairs {told['open'] / told['pairs']:.2%}, recall {recall:.4f}, codes {middle - began:.2f} s, plain product and sort {end - middle:.2f} s")
    assert codes.bits.dtype == np.uint64 and codes.bits.shape == (8, 3000)
    assert told["open"] < 0.03 * told["pairs"] and recall > 0.99
    assert np.allclose(value, np.take_along_axis(x[:1000] @ x.T, at, 1))


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = unit(rng.standard_normal((800, 96)) + 0.7)
    center, turn = x.mean(0).astype(np.float32), knn.rotation(96, 512, 1)
    upper = knn.Codes.of(x.astype(np.float32), center, turn).upper(x[:100].astype(np.float32), center, turn, 1.9)
    assert np.mean(x[:100] @ x.T <= upper) > 0.94 and np.abs(upper - x[:100] @ x.T).mean() < 0.2


def test_cells_of_two_levels(spark, cloud):
    """Leaves fitted by the workers: none gets far beyond its share, however dense a region is."""
    rng = np.random.default_rng(8)
    dense = np.ones(DIM) + rng.standard_normal((600, DIM)) * 1e-3
    vectors = cloud | {f"e{i}": v for i, v in enumerate(dense.astype(np.float32))}
    df = table(spark, [row(n, v) for n, v in vectors.items()])
    rows = vector_table(df, "doc_id", "embedding", DIM, 1).rows
    found, sizes = cells.fit_cells(rows, len(vectors), DIM, 40, 7, driver_sample=100)
    at, border = found.place(unit(np.array(list(vectors.values()))).astype(np.float32), 3)
    held = np.bincount(at[:, 0], minlength=len(found.leaves))
    assert len(found.tops) > 1 and len(found.leaves) == found.start[-1] and held.max() <= 120
    assert abs(sizes.sum() - len(vectors)) < 0.1 * len(vectors) and (border[:, 0] == 0).all() and (border >= 0).all()
    first, parts = found.blocks(np.array([10.0, 250.0, 0.0]), 100)
    assert first.tolist() == [0, 1, 4] and parts.tolist() == [1, 3, 1]


def test_one_link_across_cells_joins_two_groups(spark):
    """Two dense groups, cut into many cells, hang together by a single document between them."""
    rng = np.random.default_rng(9)
    a, b = np.eye(DIM)[0], np.eye(DIM)[1]
    groups = {f"{n}{i:03d}": c + rng.standard_normal(DIM) * 0.03 for n, c in (("a", a), ("b", b)) for i in range(120)}
    apart = table(spark, [row(n, v) for n, v in groups.items()])
    joined = table(spark, [row(n, v) for n, v in (groups | {"m": a + b}).items()])
    found = [{r.doc_id: r.cluster for r in clusters.similarity_clusters(df, "doc_id", "embedding", 0.66, 5, DIM, cell_rows=30).collect()} for df in (apart, joined)]
    assert set(found[0].values()) == {"a000", "b000"} and set(found[1].values()) == {"a000"} and len(found[1]) == 241


def test_crowds_of_visitors_come_in_shares(spark, cloud):
    """Blocks of 12 rows: every cell is cut, and its blocks have more visitors than a block."""
    df = table(spark, [row(n, v) for n, v in cloud.items()])
    got, want = knn.most_similar(df, "doc_id", "embedding", 5, DIM, cell_rows=130, block=12, reach=9.0), brute(cloud, 5)
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append((r.rank, r.neighbour))
    assert sum([n for _, n in sorted(found[d])] == w for d, w in want.items()) >= 0.98 * len(want)


@pytest.mark.parametrize("n", [320, 321, 352, 400, 479, 480])
def test_cells_of_any_size_are_searched(n):
    """Cells of 321 to 479 rows have fewer groups of rows than thrice the neighbours sought."""
    rng = np.random.default_rng(n)
    x = unit(rng.standard_normal((n, 96)) + 0.5)
    center, turn = x.mean(0).astype(np.float32), knn.rotation(96, 384, 7)
    at, _ = knn.search(x, knn.Codes.of(x.astype(np.float32), center, turn), x, np.arange(n), 5, center, turn, 9.0)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert (at == np.argsort(-s, axis=1, kind="stable")[:, :5]).all()


def test_cells_are_fitted_alike_at_every_size(spark, cloud):
    """Whether the sample would fit onto the driver changes nothing."""
    rows = vector_table(table(spark, [row(n, v) for n, v in cloud.items()]), "doc_id", "embedding", DIM, 1).rows
    fits = [cells.fit_cells(rows, len(cloud), DIM, 20, 7, driver_sample=most, seeded=lambda k: clusters.kmeans_parallel(rows, DIM, k, seed=7)) for most in (100, 1 << 15)]
    assert all((a == b).all() for a, b in zip(*([c.tops, c.leaves, c.start, sizes] for c, sizes in fits), strict=True))
