"""Vector tables: usable rows, classes of equal vectors, assignment to cells, blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.llm.common import pack, unit, unpack, vectors
from corpusmith.session import materialise

_ODD = np.random.default_rng(20240501).integers(1, 2**63, (2, 4096), dtype=np.uint64) | np.uint64(1)


def fingerprints(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's bits."""
    words = m.view(np.uint32).astype(np.uint64)
    out = []
    for k in range(2):
        h = (words * _ODD[k, : words.shape[1]]).sum(1, dtype=np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        out.append((h ^ (h >> np.uint64(29))).view(np.int64))
    return out[0], out[1]


@dataclass
class VectorTable:
    rows: DataFrame  # id, h1, h2, v (packed float32); rows may repeat
    spare: DataFrame | None  # id, h1, h2 of documents beyond the first ``keep`` with the same vector
    n: int  # documents


def vector_table(df: DataFrame, id_col: str, vec_col: str, dim: int, keep: int, broadcast_rows: int = 500_000) -> VectorTable:
    """The usable vectors, each document once; of documents with equal vectors only the ``keep`` smallest ids stay in ``rows``.

    Of an id with several usable vectors the one with the smallest fingerprint counts. The joins that drop rows are only
    run where there is something to drop, which is looked up first; the result is the same either way.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, m = vectors(b.column(1), dim)
            h1, h2 = fingerprints(m)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(h1), pa.array(h2), pack(m)], ["id", "h1", "h2", "v"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("e")).mapInArrow(read, f"id {kind}, h1 bigint, h2 bigint, v binary")
    h = F.struct("h1", "h2")
    keys = materialise(rows.groupBy("id").agg(F.min(h).alias("h"), F.max(h).alias("other")))
    n = keys.count()
    if keys.where("h <> other").limit(1).count():
        rows = rows.join(keys.select("id", "h.h1", "h.h2"), ["id", "h1", "h2"], "left_semi")
    spare = None
    if keys.groupBy("h").count().where(F.col("count") > keep).limit(1).count():
        first = keys.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("r") <= keep)
        spare = materialise(keys.join(first.select("id"), "id", "left_anti").select("id", "h.h1", "h.h2"))
        few = spare.limit(broadcast_rows + 1).count() <= broadcast_rows  # else the vectors are shuffled for the join
        rows = rows.join(F.broadcast(spare.select("id")) if few else spare.select("id"), "id", "left_anti")
    return VectorTable(rows, spare, n)


def sample_vectors(rows: DataFrame, n: int, at_most: int, dim: int) -> np.ndarray:
    """About ``at_most`` unit vectors (all, if there are fewer), picked by fingerprint: the same ones on every run."""
    share = min(1.0, at_most / max(n, 1))
    got = rows.where(F.pmod(F.col("h1"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("h1", "h2", "v").toArrow()
    m = unpack(got["v"], dim)
    order = np.lexsort((got["h2"].to_numpy(), got["h1"].to_numpy()))
    return unit(m[order]).astype(np.float32) if len(m) else np.empty((0, dim), np.float32)


def lloyd(x: np.ndarray, centers: np.ndarray, rounds: int, weights: np.ndarray | None = None) -> np.ndarray:
    """K-means steps on the driver over a bounded sample; an empty cell keeps its centre."""
    w = np.ones(len(x)) if weights is None else weights
    for _ in range(rounds):
        near = nearest(x, centers, 1)[:, 0]
        size = np.bincount(near, w, len(centers))
        for j in np.flatnonzero(size):
            own = near == j
            centers[j] = (x[own] * w[own, None]).sum(0) / size[j]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of each row, nearest first."""
    d = (centers * centers).sum(1)[None, :] - 2 * (x @ centers.T)
    k = min(k, len(centers))
    if k == 1:
        return d.argmin(1)[:, None]
    part = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1)


def seed_plus_plus(x: np.ndarray, k: int, seed: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Weighted k-means++ seeding over a bounded set."""
    rng, w = np.random.default_rng(seed), np.ones(len(x)) if weights is None else weights
    picks = [int(rng.choice(len(x), p=w / w.sum()))]
    d = ((x - x[picks[0]]) ** 2).sum(1)
    while len(picks) < min(k, len(x)):
        p = np.maximum(d, 0) * w
        if p.sum() <= 0:
            break
        picks.append(int(rng.choice(len(x), p=p / p.sum())))
        d = np.minimum(d, ((x - x[picks[-1]]) ** 2).sum(1))
    return x[picks].copy()
