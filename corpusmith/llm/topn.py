"""The N best items of every group, by one global sort and exact positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.session import materialise


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, n: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(group, item, score, position) of the ``n`` best items of each group; equal scores by rising item.

    Rows with a null group, item or score, a NaN score or one outside ``low..high`` don't take part. Repeated rows
    of an item in a group count once, with the best score. Other columns are ignored. Empty input: empty result.

    The rows are range-partitioned and sorted by group, score and item. Each partition reports how many rows it
    holds of each group and keeps the first ``n`` of them (later ones can't come among the first ``n``); a prefix sum
    of the counts over the partitions that share a group turns places in the partition into exact positions. A group
    of any size spreads over many partitions, and nothing holds more than one batch.
    """
    value = F.col(score).cast("double")
    keep = F.col(group).isNotNull() & F.col(item).isNotNull() & value.isNotNull() & ~F.isnan(value)
    if low is not None:
        keep &= value >= low
    if high is not None:
        keep &= value <= high
    rows = df.where(keep).groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(F.max(value).alias("s"))
    order = [F.col("g").asc(), F.col("s").desc(), F.col("i").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind_g, kind_i = rows.schema["g"].dataType, rows.schema["i"].dataType
    schema = T.StructType(
        [T.StructField("g", kind_g), T.StructField("i", kind_i), T.StructField("s", T.DoubleType()), T.StructField("pid", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("held", T.LongType())]
    )

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, group_now, held = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if b.empty:
                continue
            start = (b["g"] != b["g"].shift()).to_numpy()
            start[0] = b["g"].iloc[0] != group_now
            run = start.cumsum()
            place = b.groupby(run).cumcount().to_numpy() + 1
            place[run == 0] += held
            ends = b.groupby(run).size()
            if 0 in ends.index:
                ends[0] += held
            closed = [] if group_now is None or not start[0] else [(group_now, held)]
            names = b["g"].groupby(run).first()
            closed += list(zip(names.iloc[:-1], ends.iloc[:-1], strict=True))
            group_now, held = names.iloc[-1], int(ends.iloc[-1])
            yield b[place <= n].assign(pid=pid, place=place[place <= n], held=pd.array([pd.NA] * int((place <= n).sum()), "Int64"))
            if closed:
                yield tally(pid, closed)
        if group_now is not None:
            yield tally(pid, [(group_now, held)])

    def tally(pid: int, closed: list[tuple[object, int]]) -> pd.DataFrame:
        kinds = {"s": "float64", "place": "Int64", "held": "Int64"}
        return pd.DataFrame([(g, None, None, pid, None, h) for g, h in closed], columns=["g", "i", "s", "pid", "place", "held"]).astype(kinds)

    local = materialise(ordered.mapInPandas(places, schema))
    before = Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = local.where("held is not null").select("g", "pid", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"))
    placed = local.where("place is not null").join(counts, ["g", "pid"]).withColumn("position", F.col("place") + F.col("ahead"))
    return placed.where(F.col("position") <= n).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("position").cast("int").alias("position"))
