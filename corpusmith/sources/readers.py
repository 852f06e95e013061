"""Corpora from CSV, parquet, JSON, ORC and text files, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmith.session import materialise

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc", ".txt": "text"}


@dataclass(frozen=True)
class CorpusSpec:
    """Which columns hold text, id, time, place and category."""

    text: str = "text"
    id: str | None = None
    time: str | None = None
    geo: str | None = None
    category: str | None = None

    def check(self, df: DataFrame) -> DataFrame:
        missing = [c for c in (self.text, self.id, self.time, self.geo, self.category) if c is not None and c not in df.columns]
        if missing:
            raise ValueError(f"columns not found: {', '.join(missing)}")
        return df


def format_of(path: str) -> str:
    for suffix, name in FORMATS.items():
        if path.rstrip("/").endswith(suffix):
            return name
    raise ValueError(f"no known format: {path}")


def _options(fmt: str) -> dict[str, str]:
    return {"header": "true", "multiLine": "true", "escape": '"'} if fmt == "csv" else {}


def load(data: str | DataFrame, spec: CorpusSpec, spark: SparkSession | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A file or table with the columns checked; CSV is read with quotes and line breaks inside fields."""
    if isinstance(data, DataFrame):
        return spec.check(data)
    fmt = format_of(data)
    reader = (spark or SparkSession.getActiveSession()).read.format(fmt).options(**_options(fmt))
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", "true")
    return spec.check(reader.load(data))


def scan(spark: SparkSession, path: str, text: str, id_col: str | None = None, where: str | Column | Callable[[DataFrame], DataFrame] | None = None, fmt: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """(id, text) of a file: filter and projection reach the scan. Without an id column the ids only tell rows apart."""
    fmt = fmt or format_of(path)
    reader = spark.read.format(fmt).options(**_options(fmt))
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    if callable(where) and not isinstance(where, Column):
        df = df.transform(where)
    elif where is not None:
        df = df.filter(where)
    ident = F.col(id_col) if id_col else F.monotonically_increasing_id()
    return df.select(ident.alias("id"), F.col(text).alias("text"))


def stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """The files of a folder as a stream."""
    fmt = fmt or format_of(path)
    return spark.readStream.format(fmt).schema(schema).options(**_options(fmt)).option("maxFilesPerTrigger", files_per_trigger).load(path)


def upload(spark: SparkSession, path: str) -> DataFrame:
    """(text) of an uploaded file: lines of a TXT, column ``text`` or else the first of a CSV; blank ones are dropped."""
    if format_of(path) == "text":
        out = spark.read.text(path).select(F.col("value").alias("text"))
    else:
        df = spark.read.options(**_options("csv")).csv(path)
        out = df.select(F.col("text" if "text" in df.columns else df.columns[0]).alias("text"))
    return out.where(F.trim("text") != "")


def with_ids(df: DataFrame, *order: str, name: str = "doc_id") -> DataFrame:
    """``doc_0``, ``doc_1``, ... by an explicit order: a range-partitioned sort, places in the partition and offsets of the partitions."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(sorted_.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))
    ahead = F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_held")).select("_part", ahead.alias("_ahead"))  # one row a partition
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.select(*df.columns, F.concat(F.lit("doc_"), (F.col("_place") + F.col("_ahead")).cast("string")).alias(name))


def from_iterator(spark: SparkSession, rows: Iterable[tuple], schema: StructType | str, path: str, batch_rows: int = 10_000, restart: bool = False) -> DataFrame:
    """A table of what an iterator yields, which may be longer than memory: ``batch_rows`` rows at a time are written under ``path``.

    Batches that a former run with the same path has finished are skipped; ``restart`` begins anew.
    """
    it, n = iter(rows), 0
    while batch := list(islice(it, batch_rows)):
        to = f"{path}/batch={n}"
        if restart or not _finished(spark, to):
            spark.createDataFrame(batch, schema).write.mode("overwrite").parquet(to)
        n += 1
    kind = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    if not n:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(*[f"{path}/batch={i}" for i in range(n)])


def _finished(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
