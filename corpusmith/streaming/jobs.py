"""Structured Streaming: scoring, embedding, windowed topic counts, incremental model refresh."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmith.operators import models, vectorize


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, into parquet, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def embed_stream(df: DataFrame, id_col: str, text: str, encoder: vectorize.Encoder | None = None) -> DataFrame:
    return vectorize.embed(df, id_col, text, encoder)


def score_stream(df: DataFrame, id_col: str, vec: str, centers: np.ndarray) -> DataFrame:
    """Stateless scoring by given centres: columns ``topic`` and ``topic_prob`` are added."""
    scored = models.assign_to_centers(df, id_col, vec, centers)
    return scored.select(F.col("id").alias(id_col), F.col("topic_id").alias("topic"), F.col("probability").alias("topic_prob"))


def topic_counts(df: DataFrame, time: str, topic: str, window: str = "1 day", late: str = "7 days", value: str | None = None) -> DataFrame:
    """(window_start, topic, count, sum) by event time with a watermark; times without a zone are read in the session's."""
    stamped = df.withColumn("_t", F.col(time).cast("timestamp")).where(F.col(topic).isNotNull() & F.col("_t").isNotNull())
    sums = [F.coalesce(F.sum(value), F.lit(0)).alias("total")] if value else []
    return stamped.withWatermark("_t", late).groupBy(F.window("_t", window).alias("w"), F.col(topic).alias("topic")).agg(F.count("*").alias("count"), *sums).select(F.col("w.start").alias("window_start"), "topic", "count", *[c.alias("total") for c in [F.col("total")] if value])


class Refresh:
    """Mini-batch k-means whose centres live in a table of versions; a repeated batch is recognised and skipped.

    ``online`` updates every ``interval`` batches, ``batch`` as soon as ``batch_size`` x ``interval`` rows have come;
    what is left is used by ``flush``. The first update fits the model.
    """

    def __init__(self, path: str, vec: str, k: int, mode: str = "online", interval: int = 1, batch_size: int = 1000, seed: int = 42):
        if mode not in ("online", "batch"):
            raise ValueError("mode must be online or batch")
        self.path, self.vec, self.k, self.mode, self.interval, self.batch_size, self.seed = path, vec, k, mode, interval, batch_size, seed

    def _state(self, spark):
        try:
            rows = spark.read.parquet(f"{self.path}/centers").orderBy(F.desc("batch_id")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return -1, None, None
        if not rows:
            return -1, None, None
        r = rows[0]
        return r.batch_id, np.array(json.loads(r.centers)), np.array(json.loads(r.weights))

    def centers(self, spark) -> np.ndarray | None:
        return self._state(spark)[1]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last, _, _ = self._state(spark)
        if batch_id <= last:
            return
        batch.select(F.col(self.vec).alias("v")).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.path}/buffer/batch={batch_id}")
        waiting = self._waiting(spark, last, batch_id)
        if waiting is None:
            return
        enough = batch_id - last >= self.interval if self.mode == "online" else waiting.count() >= self.batch_size * self.interval
        if enough:
            self._update(spark, waiting, batch_id)

    def _waiting(self, spark, last: int, upto: int) -> DataFrame | None:
        try:
            held = spark.read.parquet(f"{self.path}/buffer")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return held.where((F.col("batch_id") > last) & (F.col("batch_id") <= upto))

    def flush(self, spark, upto: int) -> None:
        last, _, _ = self._state(spark)
        waiting = self._waiting(spark, last, upto)
        if waiting is not None and waiting.limit(1).count():
            self._update(spark, waiting, upto)

    def _update(self, spark, rows: DataFrame, batch_id: int) -> None:
        _, centers, weights = self._state(spark)
        if centers is None:
            centers = np.stack(models.kmeans_fit(rows.withColumn("id", F.monotonically_increasing_id()), "id", "v", self.k, self.seed).clusterCenters())
            weights = np.zeros(len(centers))
        total, count = models.nearest_sums(rows, "v", centers)
        held = count > 0
        merged = weights + count
        centers[held] = (centers[held] * weights[held, None] + total[held]) / merged[held, None]
        row = [(batch_id, json.dumps(centers.tolist()), json.dumps(merged.tolist()))]
        spark.createDataFrame(row, "batch_id long, centers string, weights string").write.mode("append").parquet(f"{self.path}/centers")


def progress(query: StreamingQuery) -> dict[str, object]:
    """Counters of a query so far."""
    rows = query.recentProgress
    return {"batches": len(rows), "rows": sum(int(p["numInputRows"]) for p in rows), "ms": sum(int(p["durationMs"].get("triggerExecution", 0)) for p in rows)}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def clean(spark: SparkSession, *paths: str) -> None:
    """Removes outputs, buffers and checkpoints of finished streams, on whatever file system they are."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Latest:
    """A sink for aggregates in update mode: every batch's changed rows as a table, of which the last of each key count."""

    def __init__(self, path: str, *keys: str):
        self.path, self.keys = path, keys

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        last = Window.partitionBy(*self.keys).orderBy(F.desc("batch"))
        return spark.read.parquet(self.path).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "batch")
