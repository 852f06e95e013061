"""The k most similar vectors of every vector, by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from corpusmith.llm.cells import Cells, fit_cells
from corpusmith.llm.common import pack, unit, unpack
from corpusmith.llm.vectors import vector_table
from corpusmith.session import materialise

_NOISE = 0.13  # share of a query's square length that its two bits a coordinate don't hold


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """(dim, bits): the vector is padded with zeros to ``bits`` coordinates and turned at random."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T, np.float32)


def packed(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs, axis=1).view(np.uint64)


@dataclass
class Codes:
    """One bit a rotated coordinate of each residual, packed, and the scalars that correct the estimate."""

    bits: np.ndarray  # (words, rows) uint64
    weight: np.ndarray  # what a unit of the sum of signs is worth
    base: np.ndarray  # inner product with the centre
    error: np.ndarray  # standard error of the estimate, for a query residual of length one

    @classmethod
    def of(cls, x: np.ndarray, center: np.ndarray, turn: np.ndarray) -> Codes:
        turned, n = (x - center) @ turn, turn.shape[1]
        length = np.linalg.norm(turned, axis=1)
        fit = np.abs(turned).sum(1) / np.sqrt(n) / np.maximum(length, 1e-12)  # inner product of the residual's direction with its code
        fit[length <= 1e-12] = 1.0
        weight = length / fit / np.sqrt(n)
        error = weight * np.sqrt(np.maximum(1 - fit**2, 0) + _NOISE)
        return cls(np.ascontiguousarray(packed(turned > 0).T), weight.astype(np.float32), (x @ center).astype(np.float32), error.astype(np.float32))

    def upper(self, q: np.ndarray, center: np.ndarray, turn: np.ndarray, epsilon: float, rows: int = 32, columns: int = 1024) -> np.ndarray:
        """(queries, rows) upper bounds of the inner products, ``epsilon`` standard errors above the estimates.

        A query's rotated residual is kept to two bits a coordinate, 2 s1 + s0 of two planes of signs, so the inner product with a code
        is a sum of two popcounts of packed words.
        """
        turned, n = (q - center) @ turn, turn.shape[1]
        length = np.linalg.norm(turned, axis=1)
        scale = np.maximum(length, 1e-12)[:, None] / np.sqrt(n)
        plus, large = turned > 0, np.abs(turned) > 0.9957 * scale
        coarse = np.where(plus, 1, -1) * np.where(large, 3, 1)
        gain = length**2 / np.maximum((coarse * turned).sum(1), 1e-12)
        high, low = packed(plus), packed(plus == large)
        total = len(self.weight)
        apart = np.empty((len(q), total), np.uint16)
        word, ones, few = np.empty((rows, columns), np.uint64), np.empty((rows, columns), np.uint8), np.empty((rows, columns), np.uint8)
        for s in range(0, len(q), rows):
            for w in range(0, total, columns):
                own, bits = apart[s : s + rows, w : w + columns], self.bits[:, w : w + columns]
                t, c, f = (m[: own.shape[0], : own.shape[1]] for m in (word, ones, few))
                own[:] = 0
                for plane in (high[s : s + rows], low[s : s + rows]):
                    own <<= 1
                    for j in range(len(bits)):  # counts of three words fit into a byte
                        np.bitwise_xor(plane[:, j, None], bits[j], out=t)
                        if j % 3:
                            np.bitwise_count(t, out=c)
                            f += c
                        else:
                            np.bitwise_count(t, out=f)
                        if j % 3 == 2 or j == len(bits) - 1:
                            own += f
        left = np.stack([gain * 3 * n, np.ones(len(q)), q @ center - center @ center, epsilon * length], 1).astype(np.float32)
        out = left @ np.stack([self.weight, self.base, np.ones(total, np.float32), self.error])
        sums = apart.astype(np.float32)
        sums *= self.weight
        sums *= (2 * gain).astype(np.float32)[:, None]
        out -= sums
        return out


def search(data: np.ndarray, codes: Codes, queries: np.ndarray, own: np.ndarray, k: int, center: np.ndarray, turn: np.ndarray, epsilon: float, least: np.ndarray | None = None, step: int = 128, told: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of data, cosine) of the ``k`` most similar to each query; -1 where there are fewer, or fewer that reach ``least``.

    Both matrices hold unit rows in double precision; ``own`` is the query's own row or -1. Of equal values the smaller row
    comes first. A row is compared exactly only if the upper bound by its code reaches the query's threshold: ``least``, or the
    k-th best exact value among the rows with the highest bounds. ``told`` takes the numbers of pairs and of open ones.
    """
    x = data.astype(np.float32)
    best_at, best = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf)
    for s in range(0, len(queries), step):
        q64 = queries[s : s + step]
        q, me = q64.astype(np.float32), own[s : s + step]
        upper = codes.upper(q, center, turn, epsilon)
        inside = np.flatnonzero(me >= 0)
        upper[inside, me[inside]] = -np.inf  # a query isn't its own neighbour
        bar = np.full(len(q), -np.inf, np.float32) if least is None else least[s : s + step].astype(np.float32)
        if len(x) > 64 * k:
            # the best row of each of many groups of rows far apart, by bound; exact values of the best of these give a first threshold
            groups = len(x) // 32
            first = min(3 * k, groups)
            some = upper[:, : groups * 32].reshape(len(q), 32, groups).argmax(1) * groups + np.arange(groups)
            order = np.argpartition(np.take_along_axis(upper, some, 1), -first, axis=1)[:, -first:]
            some = np.take_along_axis(some, order, 1)
            exact = np.einsum("ijk,ik->ij", x[some], q)
            exact[me[:, None] == some] = -np.inf
            bar = np.maximum(bar, np.partition(exact, -k, axis=1)[:, -k])
        bar = bar - np.float32(1e-5)
        qi, di = np.nonzero(upper >= bar[:, None])
        if told is not None:
            told["pairs"], told["open"] = told.get("pairs", 0) + upper.size, told.get("open", 0) + len(qi)
        keep = (np.einsum("ij,ij->i", q[qi], x[di]) >= bar[qi]) & (me[qi] != di)
        qi, di = qi[keep], di[keep]
        exact = np.einsum("ij,ij->i", q64[qi], data[di])
        if least is not None:
            keep = exact >= least[s : s + step][qi]
            qi, di, exact = qi[keep], di[keep], exact[keep]
        order = np.lexsort((di, -exact, qi))
        qi, di, exact = qi[order], di[order], exact[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = place < k
        best_at[s + qi[keep], place[keep]], best[s + qi[keep], place[keep]] = di[keep], exact[keep]
    return best_at, best


def most_similar(
    df: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 96, probes: int = 4, reach: float = 1.5, margin: float = 0.1, cell_rows: int = 4000, block: int = 32768, task_rows: int = 8192, bits: int = 384, epsilon: float = 1.9, seed: int = 7
) -> DataFrame:
    """(id, neighbour, cosine, rank): the ``k`` most similar other documents of every document with a usable vector.

    Usable: ``dim`` finite entries, not all zero; other rows, and rows with a null id, take no part. Repeated rows count
    once; of an id with several vectors one counts. Equal similarity: smaller id first. Cosines are of the stored values in
    double precision. Extra columns are ignored; an empty table or a single document gives no rows.

    Vectors are divided into cells (see ``fit_cells``), every row in its nearest. In a cell each row is coded by one bit for
    each of ``bits`` rotated coordinates of its residual; the estimate by popcounts plus ``epsilon`` standard errors decides which
    rows are compared exactly. A vector first searches its own cell. Its k-th best value there tells how near better ones would be, and
    it then visits those of its ``probes`` nearest cells whose border is nearer than ``reach`` times the standard deviation, in one direction,
    of neighbours that near (or than ``margin``, so that near ones are sought thoroughly); a visit returns only rows at least as good. A cell estimated at over ``block`` rows is cut into
    blocks that are visited all; a block with more than ``block`` visitors gets them in shares. Documents with the very same vector stand behind their k + 1 smallest ids, among which
    all their best neighbours with cosine 1 are.
    """
    spark = df.sparkSession
    table = vector_table(df, id_col, vec_col, dim, k + 1)
    kind = df.schema[id_col].dataType.simpleString()
    if table.n < 2:
        return spark.createDataFrame([], f"{id_col} {kind}, neighbour {kind}, cosine double, rank int")
    cells, sizes = fit_cells(table.rows, table.n, dim, cell_rows, seed)
    first, parts = cells.blocks(sizes, block)
    given, turn = spark.sparkContext.broadcast((cells.tops, cells.leaves, cells.start, first, parts)), rotation(dim, bits, seed)
    owner = np.repeat(np.arange(len(parts)), parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *found, first, parts = given.value
        cells = Cells(*found)
        for b in batches:
            if b.num_rows:
                at, border = cells.place(unit(unpack(b.column(2), dim)).astype(np.float32), probes)
                home = at[:, 0]
                part = first[home] + (b.column(1).to_numpy().view(np.uint64) >> np.uint64(20)).astype(np.int64) % parts[home]
                flat = pa.FixedSizeListArray.from_arrays
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), b.column(0), b.column(2), flat(pa.array(at.ravel()), probes).cast(pa.list_(pa.int32())), flat(pa.array(border.ravel()), probes).cast(pa.list_(pa.float32()))], ["part", "id", "v", "at", "border"])

    def neighbours(at: np.ndarray, cosine: np.ndarray, names: np.ndarray, of: pa.DataType) -> pa.Array:
        held = at >= 0
        counts = np.concatenate([[0], held.sum(1).cumsum()]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays([pa.array(-cosine[held]), pa.array(names[at[held]], of)], ["minus", "id"]))

    def ordered(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ids and where their rows are."""
        return np.unique(group["id"].to_numpy(zero_copy_only=False), return_index=True)

    def center_of(part: int) -> np.ndarray:
        return given.value[1][owner[part]]

    def home(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        *_, first, parts = given.value
        part, (names, at) = group["part"][0].as_py(), ordered(group)
        raw = unpack(group["v"], dim)[at]
        data, center = unit(raw), center_of(part)
        near, cosine = search(data, Codes.of(data.astype(np.float32), center, turn), data, np.arange(len(data)), k, center, turn, epsilon)
        last = cosine[:, -1]
        leaf = group["at"].combine_chunks().values.to_numpy().reshape(-1, probes)[at]
        border = group["border"].combine_chunks().values.to_numpy().reshape(-1, probes)[at]
        with np.errstate(invalid="ignore"):
            go = border < np.maximum(reach * np.sqrt(np.maximum(2 - 2 * last, 0) / dim), margin)[:, None]
        go[:, 0] = parts[leaf[:, 0]] > 1
        go &= leaf >= 0
        lists = [[int(p) for j in np.flatnonzero(g) for p in range(first[own[j]], first[own[j]] + parts[own[j]]) if p != part] for g, own in zip(go, leaf, strict=True)]
        moves = np.array([bool(x) for x in lists])
        v = pack(raw)
        of = group.schema.field("id").type
        return pa.table({"id": pa.array(names, of), "near": neighbours(near, cosine, names, of), "least": last, "go": pa.array(lists, pa.list_(pa.int32())), "v": pa.array([x if m else None for x, m in zip(v.to_pylist(), moves, strict=True)], pa.binary())})

    def visit(key: tuple, residents: pa.Table, visitors: pa.Table) -> pa.Table:
        of = visitors.schema.field("id").type
        if not residents.num_rows or not visitors.num_rows:
            return pa.table({"id": pa.array([], of), "near": pa.array([], pa.list_(pa.struct([("minus", pa.float64()), ("id", of)])))})
        residents, visitors = residents.combine_chunks(), visitors.combine_chunks()
        (names, at), center = ordered(residents), center_of(key[0].as_py())
        data = unit(unpack(residents["v"], dim)[at])
        queries = unit(unpack(visitors["v"], dim))
        near, cosine = search(data, Codes.of(data.astype(np.float32), center, turn), queries, np.full(len(queries), -1), k, center, turn, epsilon, visitors["least"].to_numpy())
        some = np.flatnonzero(near[:, 0] >= 0)
        return pa.table({"id": visitors["id"].take(pa.array(some)), "near": neighbours(near[some], cosine[some], names, of)})

    tasks = int(np.clip(table.n // task_rows, spark.sparkContext.defaultParallelism, 1 << 17))
    lists = f"near array<struct<minus:double,id:{kind}>>"
    placed = table.rows.select("id", "h1", "v").mapInArrow(place, f"part int, id {kind}, v binary, at array<int>, border array<float>").repartition(tasks, "part").persist(StorageLevel.MEMORY_AND_DISK)
    first_round = placed.groupBy("part").applyInArrow(home, f"id {kind}, {lists}, least double, go array<int>, v binary").persist(StorageLevel.MEMORY_AND_DISK)
    visits = first_round.where(F.size("go") > 0).select(F.explode("go").alias("part"), "id", "v", "least").repartition(tasks, "part")
    residents, keys = placed.select("part", "id", "v"), ["part"]
    crowded = {r.part: -(-r.n // block) for r in visits.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()}  # at most a row a block
    if crowded:  # more visitors than a task should hold come in shares, each to a copy of the residents
        shares = F.coalesce(F.create_map(*[F.lit(x) for p in crowded.items() for x in p])[F.col("part")], F.lit(1))
        visits = visits.withColumn("share", F.pmod(F.xxhash64("id"), shares).cast("int"))
        residents, keys = residents.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))), ["part", "share"]
    better = residents.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(visit, f"id {kind}, {lists}")
    moving = first_round.where(F.size("go") > 0).select("id", "near").unionByName(better).groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    merged = materialise(first_round.where(F.size("go") == 0).select("id", "near").unionByName(moving))
    first_round.unpersist()
    placed.unpersist()
    out = merged.select("id", F.posexplode("near").alias("p", "x")).select("id", F.col("x.id").alias("neighbour"), (-F.col("x.minus")).alias("cosine"), (F.col("p") + 1).cast("int").alias("rank"))
    if table.spare is not None:  # documents beyond the first k + 1 of a vector share the best k of these: their own class comes first
        kept = table.rows.select("id", "h1", "h2").distinct()
        ranked = kept.join(table.spare.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids"))
        extra = table.spare.join(ranked, ["h1", "h2"]).select("id", F.posexplode("ids").alias("p", "neighbour"))
        out = out.unionByName(extra.select("id", "neighbour", F.lit(1.0).alias("cosine"), (F.col("p") + 1).cast("int").alias("rank")))
    return out.select(F.col("id").alias(id_col), "neighbour", "cosine", "rank")
