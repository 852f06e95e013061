import numpy as np
from pyspark.sql import functions as F

from corpusmith.operators import models
from corpusmith.streaming import jobs


def rows(spark, path, parts=3):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4) + 6 * (i % 2)]) for i in range(60)], "id long, v array<double>")
    df.repartition(parts).write.parquet(path)
    return df


def test_stream_is_batch(spark, tmp_path):
    df = rows(spark, str(tmp_path / "in"))
    centers = np.array([[0.0] * 4, [6.0] * 4])
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.to_table(jobs.score_stream(live, "id", "v", centers), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    key = lambda d: sorted((r.id, r.topic) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(models.assign_to_centers(df, "id", "v", centers).select("id", F.col("topic_id").alias("topic")))
    assert jobs.progress(q)["rows"] == 60


def test_refresh(spark, tmp_path):
    df = rows(spark, str(tmp_path / "in"))
    refresh = jobs.Refresh(str(tmp_path / "state"), "v", 2)
    refresh(df, 0)
    first = refresh.centers(spark)
    refresh(df, 0)  # a repeated batch changes nothing
    assert np.array_equal(refresh.centers(spark), first)
    assert sorted(first.mean(1).round()) == [0, 6]
    late = jobs.Refresh(str(tmp_path / "other"), "v", 2, "batch", 2, 50)
    late(df, 0)
    assert late.centers(spark) is None
    late.flush(spark, 0)
    assert late.centers(spark) is not None
