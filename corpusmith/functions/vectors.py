"""Vector expressions over arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dot_literal(v: Column, values: list[float]) -> Column:
    """Dot product with a vector known to the driver."""
    return dot(v, F.array(*[F.lit(float(x)) for x in values]))


def entropy(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def margin(p: Column) -> Column:
    ordered = F.sort_array(p, asc=False)
    return 1.0 - (F.try_element_at(ordered, F.lit(1)) - F.coalesce(F.try_element_at(ordered, F.lit(2)), F.lit(0.0)))


def least_confidence(p: Column) -> Column:
    return 1.0 - F.array_max(p)


def mean_vectors(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, n, v): number and mean of the vectors of each group, added up within the batches, then by group."""
    kind = df.schema[group].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at, names = pd.factorize(b["g"])
                x, order = np.stack(b["v"].to_numpy()), np.argsort(at, kind="stable")
                sums = np.add.reduceat(x[order], np.searchsorted(at[order], np.arange(len(names))), axis=0)
                yield pd.DataFrame({"g": names, "n": np.bincount(at), "s": list(sums)})

    def total(b: pd.DataFrame) -> pd.DataFrame:
        n = int(b["n"].sum())
        return pd.DataFrame({"group": b["g"].iloc[:1], "n": [n], "v": [np.sum(np.stack(b["s"]), 0) / n]})

    some = df.where(F.col(vec).isNotNull()).select(F.col(group).alias("g"), F.col(vec).cast("array<double>").alias("v"))
    return some.mapInPandas(partial, f"g {kind}, n bigint, s array<double>").groupBy("g").applyInPandas(total, f"group {kind}, n bigint, v array<double>")
