"""Clusters of similar records: k-means with parallel oversampled seeding, exact chains, typical members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from corpusmith.llm.cells import Cells, fit_cells
from corpusmith.llm.common import connected_components, unit, unpack
from corpusmith.llm.terms import find_terms
from corpusmith.llm.vectors import lloyd, nearest, seed_plus_plus, vector_table
from corpusmith.session import materialise


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    best = np.full(len(x), np.inf, np.float32)
    for s in range(0, len(centers), 2048):
        c = centers[s : s + 2048]
        best = np.minimum(best, ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).min(1))
    return np.maximum(best + (x * x).sum(1), 0)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    z = h.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def kmeans_parallel(rows: DataFrame, dim: int, k: int, rounds: int = 3, iterations: int = 3, seed: int = 11) -> np.ndarray:
    """Centres of distributed k-means over unit vectors: oversampled seeding in ``rounds`` passes, weighted reduction to ``k``, Lloyd steps.

    ``rows`` has h1 and v. The driver holds about 2 k rounds candidates and k centres, never the rows.
    """
    spark = rows.sparkSession
    rows = rows.select("h1", "v")
    first = rows.orderBy("h1").limit(1).toArrow()
    centers = unit(unpack(first["v"], dim)).astype(np.float32)
    oversample = 2 * k

    def cost_of(given) -> float:
        def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for b in batches:
                if b.num_rows:
                    total += float(_distances(unit(unpack(b.column(1), dim)).astype(np.float32), given.value).sum(dtype=np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["c"])

        return rows.mapInArrow(cost, "c double").agg(F.sum("c")).first()[0] or 0.0

    for turn in range(rounds):
        given = spark.sparkContext.broadcast(centers)
        total = cost_of(given)
        if total <= 0:
            break

        def draw(batches: Iterator[pa.RecordBatch], given=given, total=total, turn=turn) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = _distances(unit(unpack(b.column(1), dim)).astype(np.float32), given.value)
                    yield b.take(pa.array(np.flatnonzero(_uniform(b.column(0).to_numpy(), seed + turn) < oversample * d / total)))

        got = rows.mapInArrow(draw, "h1 bigint, v binary").toArrow()
        if got.num_rows:
            order = np.argsort(got["h1"].to_numpy(), kind="stable")
            centers = np.concatenate([centers, unit(unpack(got["v"], dim)[order]).astype(np.float32)])

    def sums(centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        given = spark.sparkContext.broadcast(centers)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, total = np.zeros(len(given.value), np.int64), np.zeros((len(given.value), dim))
            for b in batches:
                if b.num_rows:
                    x = unit(unpack(b.column(1), dim)).astype(np.float32)
                    near = nearest(x, given.value, 1)[:, 0]
                    order = np.argsort(near, kind="stable")
                    at, start = np.unique(near[order], return_index=True)
                    total[at] += np.add.reduceat(x[order], start, axis=0)
                    size += np.bincount(near, minlength=len(size))
            at = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(size[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], ["c", "n", "s"])

        def reduce(group: pa.Table) -> pa.Table:
            total = np.stack(group["s"].to_numpy()).sum(0)
            return pa.table({"c": group["c"][:1], "n": [sum(group["n"].to_pylist())], "s": pa.array([total], pa.list_(pa.float64()))})

        shape = "c int, n bigint, s array<double>"
        got = rows.mapInArrow(partial, shape).groupBy("c").applyInArrow(reduce, shape).toArrow()
        size, total = np.zeros(len(centers), np.int64), np.zeros((len(centers), dim))
        if got.num_rows:
            at = got["c"].to_numpy()
            size[at], total[at] = got["n"].to_numpy(), np.stack(got["s"].to_numpy())
        return size, total

    weight, _ = sums(centers)
    held = weight > 0
    candidates, weight = centers[held], weight[held].astype(float)
    centers = lloyd(candidates, seed_plus_plus(candidates, k, seed, weight), 8, weight)
    for _ in range(iterations):
        size, total = sums(centers)
        filled = size > 0
        centers[filled] = (total[filled] / size[filled, None]).astype(np.float32)
    return centers


def chains(x: np.ndarray, least: float, step: int = 512) -> np.ndarray:
    """Component numbers of unit rows (double precision) under cosine >= ``least``.

    All pairs are compared, a strip of rows at a time, and kept as one bit each; components are then grown over words of bits.
    """
    n, f = len(x), x.astype(np.float32)
    near = np.empty((n, -(-n // 8)), np.uint8)
    for s in range(0, n, step):
        c = f[s : s + step] @ f.T
        own = np.packbits(c >= least + 1e-5, axis=1, bitorder="little")
        unsure = np.packbits(c >= least - 1e-5, axis=1, bitorder="little") ^ own
        for i, w in zip(*np.nonzero(unsure), strict=True):
            for j in np.flatnonzero(np.unpackbits(unsure[i, w : w + 1], bitorder="little")) + 8 * w:
                own[i, w] |= np.uint8((x[s + i] @ x[j] >= least) << (j % 8))
        near[s : s + step] = own
    label, left, current = np.full(n, -1, np.int64), np.packbits(np.ones(n, bool), bitorder="little"), 0
    for i in range(n):
        if label[i] >= 0:
            continue
        new = np.array([i])
        left[i >> 3] &= np.uint8(0xFF ^ (1 << (i & 7)))
        while len(new):
            label[new] = current
            reached = np.bitwise_or.reduce(near[new], axis=0) & left
            left ^= reached
            new = np.flatnonzero(np.unpackbits(reached, count=n, bitorder="little")) if reached.any() else new[:0]
        current += 1
    return label


def similarity_clusters(df: DataFrame, id_col: str, vec_col: str, least: float = 0.66, min_size: int = 5, dim: int = 96, probes: int = 3, reach: float = 2.0, cell_rows: int = 3000, block: int = 32768, task_rows: int = 8192, seed: int = 11) -> DataFrame:
    """(cluster, id): documents that chains of cosine >= ``least`` link, in clusters of at least ``min_size``, named by their smallest id.

    Usable vectors, repeated rows, null ids, extra columns and empty tables are treated as in ``most_similar``; documents
    with the very same vector always belong together.

    Distributed k-means divides the vectors into cells of two levels (see ``fit_cells``), the upper ones by parallel oversampled seeding. A vector also visits those of its ``probes`` nearest cells, and of the nearest cells of the neighbouring upper
    cells, whose border is nearer than ``reach``
    times the standard deviation, in one direction, of vectors at the threshold. All that meet in a cell are linked exactly; a
    vector in two cells joins the chains of both, so what the cells cut apart is joined again as soon as one link across lies
    near the cut. A link whose two ends share no cell is not seen
    by itself. A cell in which over ``block`` rows meet is worked
    off in pairs of blocks by separate tasks.
    """
    spark = df.sparkSession
    table = vector_table(df, id_col, vec_col, dim, 1)
    kind = df.schema[id_col].dataType.simpleString()
    if not table.n:
        return spark.createDataFrame([], f"cluster {kind}, {id_col} {kind}")
    held = table.rows.persist(StorageLevel.MEMORY_AND_DISK)
    cells, _ = fit_cells(held, table.n, dim, cell_rows, seed, seeded=lambda k: kmeans_parallel(held, dim, k, seed=seed))
    near = np.float32(reach * np.sqrt(max(2 - 2 * least, 0) / dim))
    found = spark.sparkContext.broadcast((cells.tops, cells.leaves, cells.start))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(*found.value)
        total = np.zeros(len(cells.leaves), np.int64)
        for b in batches:
            if b.num_rows:
                at, border = cells.place(unit(unpack(b.column(0), dim)).astype(np.float32), probes, apart=True)
                total += np.bincount(at[(border < near) & (at >= 0)], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    sizes = np.zeros(len(cells.leaves))
    for r in held.select("v").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a cell
        sizes[r.cell] = r.n
    _, parts = cells.blocks(sizes, block)
    given = spark.sparkContext.broadcast((cells.tops, cells.leaves, cells.start, parts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *found, parts = given.value
        cells = Cells(*found)
        for b in batches:
            if b.num_rows:
                at, border = cells.place(unit(unpack(b.column(2), dim)).astype(np.float32), probes, apart=True)
                row, j = np.nonzero((border < near) & (at >= 0))
                cell, own = at[row, j], (b.column(1).to_numpy().view(np.uint64) >> np.uint64(20)).astype(np.int64)[row] % parts[at[row, j]]
                # a row of a divided cell meets each other block in a task of its own
                n = np.maximum(parts[cell] - 1, 1)
                each = np.repeat(np.arange(len(row)), n)
                other = np.arange(len(each)) - np.repeat(n.cumsum() - n, n)
                other += (parts[cell[each]] > 1) & (other >= own[each])
                pair = np.minimum(own[each], other) * parts[cell[each]] + np.maximum(own[each], other)
                pair[parts[cell[each]] == 1] = 0
                rows = pa.array(row[each])
                yield pa.RecordBatch.from_arrays([pa.array(cell[each]), pa.array(pair.astype(np.int32)), b.column(0).take(rows), b.column(2).take(rows)], ["cell", "pair", "id", "v"])

    tasks = int(np.clip(2 * table.n // task_rows, spark.sparkContext.defaultParallelism, 1 << 17))
    meeting = held.select("id", "h1", "v").mapInArrow(place, f"cell int, pair int, id {kind}, v binary").repartition(tasks, "cell", "pair")

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, first = np.unique(group["id"].to_numpy(zero_copy_only=False), return_index=True)
        label = chains(unit(unpack(group["v"], dim)[first]), least)
        order = np.argsort(label, kind="stable")
        at, start, size = np.unique(label[order], return_index=True, return_counts=True)
        names = np.empty(label.max() + 1, object)
        names[at] = ids[order[start]]
        linked = np.isin(label, at[size > 1])
        kind = group.schema.field("id").type
        return pa.table({"id": pa.array(ids[linked], kind), "chain": pa.array(names[label[linked]], kind)})

    chained = meeting.groupBy("cell", "pair").applyInArrow(link, f"id {kind}, chain {kind}")
    members = materialise(chained.groupBy("id").agg(F.collect_set("chain").alias("chains")))
    held.unpersist()
    spread = members.where(F.size("chains") > 1).select(F.explode(F.slice("chains", 2, 1 << 30)).alias("a"), F.col("chains")[0].alias("b")).distinct()
    joined = connected_components(spread, "a", "b")
    found = members.select("id", F.col("chains")[0].alias("node")).join(joined, "node", "left").select("id", F.coalesce("component", "node").alias("c"))
    if table.spare is not None:
        first = table.rows.select("id", "h1", "h2").distinct()
        alike = table.spare.select(F.col("id").alias("copy"), "h1", "h2").join(first, ["h1", "h2"]).select("copy", "id")
        own = first.join(alike.select("id").distinct(), "id", "left_semi").select("id").join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("c"))
        found = found.unionByName(own)
        found = found.unionByName(alike.join(found, "id").select(F.col("copy").alias("id"), "c"))
    found = materialise(found)
    named = found.groupBy("c").agg(F.count("*").alias("size"), F.min("id").alias("cluster")).where(F.col("size") >= min_size)
    return found.join(named, "c").select("cluster", F.col("id").alias(id_col))


def kmeans_clusters(df: DataFrame, id_col: str, vec_col: str, k: int, dim: int = 96, typical: int = 3, seed: int = 11) -> DataFrame:
    """(cluster, size, typical): ``k`` clusters by distributed k-means alone, with the ids of the members nearest each centroid.

    Vectors, ids and repeated rows are treated as in ``similarity_clusters``; fewer vectors than ``k`` give fewer clusters.
    Clusters are numbered by the smallest id they hold. Equal distances by rising id.
    """
    table = vector_table(df, id_col, vec_col, dim, 1 << 30)
    kind = df.schema[id_col].dataType.simpleString()
    if not table.n:
        return df.sparkSession.createDataFrame([], f"cluster {kind}, size bigint, typical array<{kind}>")
    held = table.rows.persist(StorageLevel.MEMORY_AND_DISK)
    given = df.sparkSession.sparkContext.broadcast(kmeans_parallel(held, dim, min(k, table.n), seed=seed).astype(np.float32))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(unpack(b.column(1), dim)).astype(np.float32)
                at = nearest(x, given.value, 1)[:, 0]
                far = np.linalg.norm(x - given.value[at], axis=1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0), pa.array(np.round(far, 6))], ["c", "id", "far"])

    placed = materialise(held.select("id", "v").mapInArrow(place, f"c int, id {kind}, far double").groupBy("id").agg(F.min(F.struct("far", "c")).alias("p")).select("id", "p.far", "p.c"))
    held.unpersist()
    sizes = placed.groupBy("c").agg(F.count("*").alias("size"), F.min("id").alias("cluster"))
    best = placed.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("far", "id"))).where(F.col("r") <= typical)
    lists = best.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda e: e["id"]).alias("typical"))
    return sizes.join(lists, "c").select("cluster", "size", "typical")


def describe_clusters(members: DataFrame, df: DataFrame, id_col: str, vec_col: str, dim: int = 96, typical: int = 3) -> DataFrame:
    """(cluster, size, typical): each cluster's size and the ids of the members nearest its centroid, nearest first.

    Centroids are means of unit vectors from partial sums; equal distances by rising id.
    """
    rows = vector_table(df, id_col, vec_col, dim, 1 << 30).rows.groupBy("id").agg(F.min("v").alias("v"))
    own = members.select("cluster", F.col(id_col).alias("id")).join(rows, "id")
    kind = own.schema["id"].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names, at = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                x, order = unit(unpack(b.column(1), dim)), np.argsort(at, kind="stable")
                sums = np.add.reduceat(x[order], np.searchsorted(at[order], np.arange(len(names))), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(names, b.column(0).type), pa.array(np.bincount(at)), pa.array(list(sums), pa.list_(pa.float64()))], ["cluster", "n", "s"])

    sums = own.select("cluster", "v").mapInArrow(partial, f"cluster {kind}, n bigint, s array<double>")
    per = sums.select("cluster", "n", F.posexplode("s").alias("j", "x")).groupBy("cluster", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    centroid = per.groupBy("cluster").agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("c"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, c = vectors64(b.column(4), dim)
            x = unit(unpack(b.column(3), dim))[at]
            cosine = np.einsum("ij,ij->i", x, c) / np.maximum(np.linalg.norm(c, axis=1), 1e-300)
            picked = [b.column(j).take(pa.array(at)) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(np.round(cosine, 9))], ["cluster", "size", "id", "cosine"])

    scored = own.join(centroid, "cluster").select("cluster", "size", "id", "v", "c").mapInArrow(near, f"cluster {kind}, size bigint, id {kind}, cosine double")
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("cosine"), "id"))).where(F.col("r") <= typical)
    return top.groupBy("cluster", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda e: e["id"]).alias("typical"))


def vectors64(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False)
    start = np.asarray(column.offsets)[:-1]
    return np.arange(len(column)), flat[start[:, None] + np.arange(dim)] if len(column) else np.empty((0, dim))


def text_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = 96, max_share: float = 0.5) -> DataFrame:
    """(id, embedding): hashed weighted features of texts: log term frequency times inverse document frequency, signed, of unit length.

    A text without terms gets an empty vector, which counts as not usable. Null ids are dropped.
    """
    spark, slots = df.sparkSession, dim * 64
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def slot(word: str) -> tuple[int, int]:
        h = hash_word(word)
        return h % slots, 1 if h >> 40 & 1 else -1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_, n = np.zeros(slots, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                at = list({slot(w)[0] for w in find_terms(t or "")})
                df_[at] += 1
                n += bool(at)
        at = np.flatnonzero(df_)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df_[at], n))], ["slot", "n"])

    got = texts.select("t").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # at most ``slots`` + 1 rows
    seen = {r.slot: r.n for r in got}
    n = seen.pop(-1, 0)
    idf = np.zeros(slots)
    for s, k in seen.items():
        idf[s] = np.log((1 + n) / (1 + k)) + 1 if k <= max_share * n else 0
    given = spark.sparkContext.broadcast(idf)
    turn = np.random.default_rng(5).standard_normal((slots, dim)).astype(np.float32)
    shared = spark.sparkContext.broadcast(turn)
    kind = df.schema[id_col].dataType.simpleString()

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[float]] = []
            for t in b.column(1).to_pylist():
                tf: dict[int, int] = {}
                for w in find_terms(t or ""):
                    s, sign = slot(w)
                    tf[s] = tf.get(s, 0) + sign
                at = [s for s, c in tf.items() if c and given.value[s]]
                if not at:
                    out.append([])
                    continue
                w = np.array([np.sign(tf[s]) * np.log1p(abs(tf[s])) * given.value[s] for s in at], np.float32)
                v = w @ shared.value[at]
                out.append((v / np.linalg.norm(v)).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], ["id", "embedding"])

    return texts.mapInArrow(vectorise, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)


def hash_word(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)
