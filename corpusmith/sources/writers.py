"""Results out: tables, reports, feedback files."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXCEL_ROWS = 1_000_000


def export(df: DataFrame, path: str, formats: tuple[str, ...] = ("csv",), embedding: str | None = None, dim: int = 0) -> dict[str, str]:
    """Write a result in some formats; embeddings as ``embedding_0``, ... columns for CSV, arrays go as JSON text."""
    out = {}
    for fmt in formats:
        to = f"{path}/results.{fmt}"
        if fmt == "csv":
            flat = df
            if embedding:
                flat = flat.select(*[c for c in df.columns if c != embedding], *[F.col(embedding)[i].alias(f"embedding_{i}") for i in range(dim)])
            flat = flat.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in flat.dtypes])
            flat.write.mode("overwrite").options(header="true", escape='"').csv(to)
        elif fmt in ("json", "parquet", "orc"):
            df.write.mode("overwrite").format(fmt).save(to)
        elif fmt == "excel":
            if df.limit(EXCEL_ROWS + 1).count() > EXCEL_ROWS:
                raise ValueError("too many rows for a sheet")
            Path(path).mkdir(parents=True, exist_ok=True)
            df.toPandas().to_excel(to := f"{path}/results.xlsx", index=False)
        else:
            raise ValueError(f"unknown format {fmt}")
        out[fmt] = to
    return out


def append_embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def json_report(report: DataFrame, path: str | None = None) -> str:
    """Topics with count and examples, and the distribution, as JSON; ``report`` has one row a topic."""
    rows = report.orderBy(F.desc("count"), "topic").collect()
    total = sum(r["count"] for r in rows) or 1
    out = json.dumps({"metadata": {"topics": len(rows), "documents": total}, "topics": [{"name": str(r.topic), "count": r["count"], "examples": list(r.examples or [])[:5]} for r in rows], "distribution": {str(r.topic): r["count"] / total for r in rows}}, ensure_ascii=False, indent=2)
    if path:
        Path(path).write_text(out, encoding="utf-8")
    return out


def _table(head: list[str], rows: list[list[object]]) -> str:
    cell = lambda x: html.escape(str(x))
    return "<table><tr>" + "".join(f"<th>{cell(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def html_report(report: DataFrame, words: DataFrame | None = None, statistics: DataFrame | None = None, title: str = "Topics", path: str | None = None, template: str | None = None) -> str:
    """A page of the topics: counts, words, examples; ``template`` may hold {title} and {body}."""
    said = {r.topic: [x.term for x in sorted(r.w, key=lambda x: x.rank)] for r in words.where("rank <= 10").groupBy("topic").agg(F.collect_list(F.struct("rank", "term")).alias("w")).collect()} if words is not None else {}
    parts = []
    if statistics is not None:
        s = statistics.first()
        parts.append(_table(list(s.asDict()), [list(s)]))
    rows = report.orderBy(F.desc("count"), "topic").collect()
    parts.append(_table(["topic", "documents", "words"], [[r.topic, r["count"], ", ".join(said.get(r.topic, []))] for r in rows]))
    for r in rows:
        parts.append(f"<h2>{html.escape(str(r.topic))}</h2><ul>" + "".join(f"<li>{html.escape(e or '')}</li>" for e in r.examples or []) + "</ul>")
    page = (template or "<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1>{body}</body></html>").replace("{title}", html.escape(title)).replace("{body}", "".join(parts))
    if path:
        Path(path).write_text(page, encoding="utf-8")
    return page


def word_report(found: DataFrame, suggestions: DataFrame, contexts: DataFrame, word: str, path: str | None = None, title: str = "Acronyms") -> str:
    """Acronyms or misspellings with counts, suggestions and up to three contexts."""
    near: dict[str, list[str]] = {}
    for r in suggestions.orderBy("word", "rank").collect():
        near.setdefault(r.word, []).append(f"{r.value} ({r.score:.0f})")
    seen: dict[str, list[str]] = {}
    for r in contexts.orderBy("word", "rank").collect():
        seen.setdefault(r.word, []).append(r.context)
    page = f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>" + _table([word, "count", "suggestions", "contexts"], [[r[word], r["count"], "; ".join(near.get(r[word], [])), " | ".join(seen.get(r[word], []))] for r in found.collect()]) + "</body></html>"
    if path:
        Path(path).write_text(page, encoding="utf-8")
    return page


def export_feedback(df: DataFrame, path: str, original: str, current: str) -> None:
    df.withColumn("changed", ~F.col(original).eqNullSafe(F.col(current))).write.mode("overwrite").options(header="true", escape='"').csv(path)


def import_feedback(docs: DataFrame, id_col: str, path: str, current: str) -> DataFrame:
    """The documents with the file's topic where it holds one."""
    held = docs.sparkSession.read.options(header="true", escape='"').csv(path).select(F.col(id_col).cast(docs.schema[id_col].dataType).alias(id_col), F.col(current).alias("_c")).dropDuplicates([id_col])
    return docs.join(held, id_col, "left").withColumn(current, F.coalesce("_c", current) if current in docs.columns else F.col("_c")).drop("_c")
