"""Occurrence and record counts of every term, by burst tries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.common import one_per_id
from corpusmith.session import materialise

_ASCII, _ANY = re.compile("[a-z]+"), regex.compile(r"\p{L}+")


def find_terms(text: str) -> list[str]:
    """The longest runs of Unicode letters in the lower-cased text."""
    text = text.lower()
    return _ASCII.findall(text) if text.isascii() else _ANY.findall(text)


class BurstTrie:
    """Terms with two counters. A container holds suffixes; past ``limit`` of them it bursts into one container a letter."""

    def __init__(self, limit: int = 2048):
        self.limit, self.root, self.size = limit, {}, 0
        self.inner: set[str] = set()
        self.leaves: dict[str, dict[str, list[int]]] = {"": {}}

    def add(self, term: str, occurrences: int, records: int) -> None:
        inner, at = self.inner, 0
        while at < len(term) and term[:at] in inner:
            at += 1
        prefix = term[:at]
        leaf = self.leaves.get(prefix)
        if leaf is None:
            leaf = self.leaves[prefix] = {}
        entry = leaf.get(term[at:])
        if entry is None:
            leaf[term[at:]] = [occurrences, records]
            self.size += 1
            if len(leaf) > self.limit and prefix not in inner:
                self._burst(prefix)
        else:
            entry[0] += occurrences
            entry[1] += records

    def _burst(self, prefix: str) -> None:
        self.inner.add(prefix)
        own = self.leaves.pop(prefix)
        for suffix, entry in own.items():
            self.leaves.setdefault(prefix + suffix[:1], {})[suffix[1:]] = entry
        for head in {s[:1] for s in own if s}:
            if len(self.leaves[prefix + head]) > self.limit:
                self._burst(prefix + head)

    def subtrees(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        yield from self.leaves.items()


def _route(term: str, inner: frozenset[str]) -> str:
    at = 0
    while at < len(term) and term[:at] in inner:
        at += 1
    return term[:at]


def _payloads(trie: BurstTrie, inner: frozenset[str]) -> pa.RecordBatch:
    """Every container under the route its terms take; a container above several routes is divided among them."""
    routed: dict[str, list[tuple[str, list[int]]]] = {}
    for prefix, leaf in trie.subtrees():
        one = _route(prefix, inner)
        whole = len(one) < len(prefix) or prefix not in inner and one == prefix
        for suffix, entry in leaf.items():
            term = prefix + suffix
            routed.setdefault(one if whole else _route(term, inner), []).append((term, entry))
    routes, terms, occ, rec = [], [], [], []
    for route, items in routed.items():
        routes.append(route)
        terms.append("\n".join(t[len(route):] for t, _ in items))
        occ.append([e[0] for _, e in items])
        rec.append([e[1] for _, e in items])
    return pa.RecordBatch.from_arrays([pa.array(routes, pa.string()), pa.array(terms, pa.string()), pa.array(occ, pa.list_(pa.int64())), pa.array(rec, pa.list_(pa.int64()))], ["route", "suffixes", "occ", "rec"])


def term_counts(df: DataFrame, id_col: str, text_col: str, min_records: int = 3, max_share: float = 0.5, burst: int = 2048, route_sample: int = 4096, flush: int = 400_000) -> DataFrame:
    """(term, occurrences, records, mark) of every term of the collection; each id counts once.

    ``mark`` is ``rare`` below ``min_records`` records, ``common`` above ``max_share`` of the records that hold any
    term, else null. Null ids are left out, null and blank texts hold no terms; texts count whole, whatever their
    length. Extra columns are ignored; empty input gives no rows.

    Each worker counts a batch and adds its distinct terms to a burst trie, which it hands on, container by
    container, whenever it holds ``flush`` terms. Containers travel under adaptive prefixes: the leaf prefixes of a trie
    over the terms of at most about ``route_sample`` records (this only places the work; counts cover everything).
    A crowded prefix thus has longer routes, and no function word is hot, since a worker sends it once.
    """
    spark = df.sparkSession
    docs = one_per_id(df.select(id_col, F.col(text_col).alias("_text")), id_col, "_text")
    total = df.count()
    share = min(1.0, route_sample / max(total, 1))
    sample = df.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select(F.col(text_col).alias("t"))
    vocabulary = sample.where("t is not null").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0)))).alias("w")).distinct()
    seed = BurstTrie(max(16, burst // 8))
    for r in vocabulary.orderBy(F.xxhash64("w")).limit(route_sample * 16).toLocalIterator():
        seed.add(r.w, 1, 1)
    routes = spark.sparkContext.broadcast(frozenset(seed.inner))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, holders = BurstTrie(burst), 0
        for batch in batches:
            occurrences: Counter[str] = Counter()
            records: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    found = find_terms(text)
                    if found:
                        holders += 1
                        occurrences.update(found)
                        records.update(set(found))
            for term, k in occurrences.items():
                trie.add(term, k, records[term])
            if trie.size > flush:
                yield _payloads(trie, routes.value)
                trie = BurstTrie(burst)
        yield _payloads(trie, routes.value)
        if holders:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([""], pa.string()), pa.array([[0]], pa.list_(pa.int64())), pa.array([[holders]], pa.list_(pa.int64()))], ["route", "suffixes", "occ", "rec"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str | None, BurstTrie] = {}
        for batch in batches:
            for route, suffixes, occ, rec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie = tries.setdefault(route, BurstTrie(burst))
                for suffix, o, r in zip(suffixes.split("\n"), occ, rec, strict=True):
                    trie.add(suffix, o, r)
        for route, trie in tries.items():
            for prefix, leaf in trie.subtrees():
                if leaf:
                    head = None if route is None else route + prefix
                    values = np.array(list(leaf.values()), np.int64)
                    names = [None] * len(leaf) if head is None else [head + s for s in leaf]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values[:, 0]), pa.array(values[:, 1])], ["term", "occurrences", "records"])

    packed = docs.select("_text").mapInArrow(count, "route string, suffixes string, occ array<bigint>, rec array<bigint>")
    merged = packed.repartition(F.col("route")).mapInArrow(merge, "term string, occurrences bigint, records bigint")
    counted = materialise(merged)
    holders = counted.where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > max_share * holders, "common")
    return counted.where("term is not null").withColumn("mark", mark)
