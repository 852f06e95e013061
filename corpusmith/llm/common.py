"""Shared pieces: one row per document, vectors over Arrow, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.session import materialise


def one_per_id(df: DataFrame, id_col: str, *cols: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per non-null id with the given columns; of repeated rows the smallest by the columns' values.

    Which ids are repeated is counted first, on the ids alone; rows of other ids stay where they are, and only repeated ones are
    shuffled (with a minimum per map task, so a hot id is no burden). Up to ``broadcast_rows`` repeated ids are sent to the rows, more are joined.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col), *[F.col(c) for c in cols])
    repeated = materialise(rows.groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(id_col))
    if repeated.limit(broadcast_rows + 1).count() <= broadcast_rows:
        repeated = F.broadcast(repeated)
    picked = F.min(F.struct(*[F.col(c) for c in cols])).alias("_r")
    again = rows.join(repeated, id_col, "left_semi").groupBy(id_col).agg(picked).select(id_col, *[F.col(f"_r.{c}").alias(c) for c in cols])
    return rows.join(repeated, id_col, "left_anti").unionByName(again)


def vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float32 matrix) of the usable lists: ``dim`` finite entries, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.empty(0, np.int64), np.empty((0, dim), np.float32)
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    fits = (lengths == dim) & ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    rows = np.flatnonzero(fits)
    flat = column.values.to_numpy(zero_copy_only=False)
    m = flat[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim))
    m = np.asarray(m, np.float32)
    ok = np.isfinite(m).all(1) & m.any(1)
    return rows[ok], np.ascontiguousarray(m[ok]) + np.float32(0)


def pack(m: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as one Arrow binary column, without a copy per row."""
    m = np.ascontiguousarray(m, np.float32)
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def unpack(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The matrix back from ``pack``'s column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, dim), np.float32)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.float32, len(column) * dim, int(first)).reshape(-1, dim)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = m.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of every chain of edges, by alternating large and small stars.

    Each round is a few aggregations with partial minima and is written to the checkpoint folder; no link
    reaches the driver, only a count and a checksum. A hub is one row per map task in each minimum.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = materialise(edges.where(F.col(a) != F.col(b)).select(u, v).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(mark):
            break
        seen = tuple(mark)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
