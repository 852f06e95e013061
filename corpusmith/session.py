"""Session defaults and the shared folder for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SPLIT_BYTES = 128 << 20  # what one task reads of a file at most by default


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it; on a cluster the caller brings the session."""
    spark = (
        SparkSession.builder.master(master)
        .appName("corpusmith")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and the session is local (tests), one is made and set."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="corpusmith-checkpoint-"))
        current = sc.getCheckpointDir()
    return configured or current


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage; the copy survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input in fewer files than cores dealt out evenly, for work that costs more than moving them; else ``df`` as it is.

    Looks at the plan's estimated size and files alone and runs nothing.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or len(df.inputFiles()) >= n:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size < n * SPLIT_BYTES else df


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/corpusmith-{name}-{uuid.uuid4().hex}"
