"""Cells of nearby vectors: two levels of centroids whose number grows with the input, and which other cells a vector must visit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.common import pack, unit, unpack
from corpusmith.llm.vectors import lloyd, nearest, sample_vectors, seed_plus_plus

_TOPS = 3  # upper cells whose leaves are looked at


def grow(x: np.ndarray, most: int, seed: int, fan: int = 16) -> np.ndarray:
    """Centres of groups of at most ``most`` rows, by k-means within groups that are still larger; equal rows stay together.

    Splitting goes by the number of rows, so a dense region gets as many centres as its rows call for.
    """
    out, stack = [], [x]
    while stack:
        own = stack.pop()
        if len(own) > most:
            k = min(fan, -(-len(own) // most))
            near = nearest(own, lloyd(own, seed_plus_plus(own, k, seed), 5), 1)[:, 0]
            groups = [own[near == j] for j in range(k)]
            if max(map(len, groups)) < len(own):
                stack += [g for g in groups if len(g)]
                continue
        out.append(own.mean(0))
    return np.array(out, np.float32).reshape(-1, x.shape[1])


def without_small(leaves: np.ndarray, sample: np.ndarray, share: float) -> np.ndarray:
    """The leaves that hold a tenth of their share of the sample: a centre of its own would cut outliers off from what is near them."""
    held = np.bincount(nearest(sample, leaves, 1)[:, 0], minlength=len(leaves))
    return leaves[held >= min(0.1 * share, held.max())]


@dataclass
class Cells:
    """Leaves in the order of the upper cells they belong to: those of upper cell t are ``start[t]`` to under ``start[t + 1]``."""

    tops: np.ndarray
    leaves: np.ndarray
    start: np.ndarray

    def place(self, x: np.ndarray, probes: int, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(rows, columns) numbers of the nearest leaves of each unit row, nearest first, and how far the row lies from their borders.

        There are ``probes`` columns, and with ``apart`` one more for the nearest leaf of each upper cell looked at, so that a row between two
        groups sees both, however finely one of them is divided. The distance to the border with the nearest leaf (column 0) is measured
        along the line through both centres; leaves that don't exist or stand in a column before are -1 at an infinite distance.
        """
        n, near = len(x), nearest(x, self.tops, _TOPS)
        best = np.full((n, probes), np.inf, np.float32)
        at = np.full((n, probes), -1, np.int32)
        other = np.full((n, near.shape[1]), np.inf, np.float32), np.full((n, near.shape[1]), -1, np.int32)
        rows, column = np.divmod(np.argsort(near.ravel(), kind="stable"), near.shape[1])
        cut = np.searchsorted(near[rows, column], np.arange(len(self.tops) + 1))
        norms = (self.leaves * self.leaves).sum(1)
        for t in np.flatnonzero(np.diff(cut)):
            own, a, b = rows[cut[t] : cut[t + 1]], self.start[t], self.start[t + 1]
            d = norms[a:b] - 2 * (x[own] @ self.leaves[a:b].T)
            if apart:
                first = d.argmin(1)
                other[0][own, column[cut[t] : cut[t + 1]]], other[1][own, column[cut[t] : cut[t + 1]]] = d[np.arange(len(d)), first], first + a
            d = np.concatenate([best[own], d], 1)
            names = np.concatenate([at[own], np.broadcast_to(np.arange(a, b, dtype=np.int32), (len(own), b - a))], 1)
            pick = np.argpartition(d, probes - 1, axis=1)[:, :probes]
            best[own], at[own] = np.take_along_axis(d, pick, 1), np.take_along_axis(names, pick, 1)
        order = np.lexsort((at, best), axis=1)
        best, at = np.take_along_axis(best, order, 1), np.take_along_axis(at, order, 1)
        if apart:
            other[1][(other[1][:, :, None] == at[:, None]).any(2)] = -1
            best, at = np.concatenate([best, other[0]], 1), np.concatenate([at, other[1]], 1)
        between = np.linalg.norm(self.leaves[at] - self.leaves[at[:, :1]], axis=2)
        with np.errstate(invalid="ignore", divide="ignore"):
            border = (best - best[:, :1]) / (2 * np.maximum(between, 1e-6))
        border[at < 0] = np.inf
        border[:, 0] = 0
        return at, border

    def blocks(self, sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(first block, number of blocks) of each leaf, for leaves of about ``sizes`` rows and blocks of about ``block``."""
        parts = np.maximum(np.ceil(sizes / block), 1).astype(np.int64)
        return parts.cumsum() - parts, parts


def fit_cells(rows: DataFrame, n: int, dim: int, cell_rows: int, seed: int, per_cell: int = 64, max_leaves: int = 1 << 20, driver_sample: int = 32_768, seeded: Callable[[int], np.ndarray] | None = None) -> tuple[Cells, np.ndarray]:
    """(cells of about ``cell_rows`` vectors, estimated vectors of each leaf) from a sample of ``per_cell`` vectors a leaf (8192 at least).

    The same steps at every size: the upper cells, about the square root of the number of leaves, come from at most about ``driver_sample``
    vectors on the driver (or from ``seeded``, a fit of its own), and the leaves are fitted by the workers, an upper cell each. The driver and the
    broadcast hold the leaves' centres, four bytes an entry; past ``max_leaves``
    (400 MB at 96 entries, some 6 billion vectors at 6,000 a cell) leaves get larger and are worked off in more blocks.
    """
    wanted = int(np.clip(round(n / cell_rows), 1, max_leaves))
    size = max(8192, per_cell * wanted)
    if seeded:
        tops = seeded(int(np.ceil(wanted**0.5)))
    else:
        sample = sample_vectors(rows, n, min(size, driver_sample), dim)
        tops = grow(sample, int(1.5 * len(sample) / wanted**0.5) + 1, seed)
    given, share = rows.sparkSession.sparkContext.broadcast(tops), min(1.0, size / n)
    most = int(1.5 * min(size, n) / wanted) + 1

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = nearest(unit(unpack(b.column(2), dim)).astype(np.float32), given.value, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *b.columns], ["top", "h1", "h2", "v"])

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h1", "ascending"), ("h2", "ascending")]).combine_chunks()
        x = unit(unpack(group["v"], dim)).astype(np.float32)
        leaves = without_small(lloyd(x, grow(x, most, seed), 2), x, most)
        held = np.bincount(nearest(x, leaves, 1)[:, 0], minlength=len(leaves))
        return pa.table({"top": pa.array(np.full(len(leaves), group["top"][0].as_py(), np.int32)), "held": held, "c": pack(leaves)})

    some = rows.where(F.pmod(F.col("h1"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("h1", "h2", "v")
    got = some.mapInArrow(upper, "top int, h1 bigint, h2 bigint, v binary").groupBy("top").applyInArrow(fit, "top int, held bigint, c binary").toArrow()
    given.unpersist()
    if not got.num_rows:  # so few distinct vectors that the sample holds none
        tops = np.nan_to_num(tops)
        return Cells(tops, tops, np.arange(len(tops) + 1)), np.full(len(tops), n / len(tops))
    own, centers = got["top"].to_numpy(), unpack(got["c"], dim)
    order = np.lexsort((*centers.T[:2], own))
    used = np.unique(own)
    cells = Cells(tops[used], centers[order], np.searchsorted(own[order], np.append(used, used[-1] + 1)))
    return cells, got["held"].to_numpy()[order] / share
