"""Test items that leaked into a corpus: prefix-filtered shingle join with exact checks over item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.shingles import hashed_words, windows


def leaked_items(corpus: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, words: int = 10, shingle: int = 5, items_per_block: int = 20_000, chars_per_block: int = 20_000_000) -> DataFrame:
    """(id, item, windows): the items of which a document holds at least ``words`` consecutive words, and how many such windows.

    Words are the longest runs of a-z and 0-9 in the lower-cased text. Null and shorter texts on either side and null ids
    take no part; repeated rows give one result row; an item repeated under an id is searched once. Extra columns are ignored;
    an empty side gives no rows. Texts are read whole.

    A window of ``words`` words holds ``words - shingle + 1`` shingles and leaks only if all of them stand in the document,
    so its prefix in the order of rarity is its rarest shingle alone (counted over the corpus; a window whose rarest
    shingle never occurs is dropped). A document's shingles are looked up among these prefix tokens; a hit fixes the
    window's place, which must lie inside the document (position and length bounds), and the words are then compared one by one.

    Items are the stated query set: about ``items_per_block`` of them or ``chars_per_block`` characters are sent to the workers at a time; a larger set is
    worked off in as many passes over the corpus.
    """
    spark = corpus.sparkSession
    kind, item_kind = corpus.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    asked = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).alias("t")).distinct()
    n, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // items_per_block), -(-chars // chars_per_block))
    docs = corpus.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    result = None
    for k in range(blocks):
        one = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else asked
        part = _search(spark, docs, one.orderBy("item", "t").collect(), words, shingle, kind, item_kind)
        result = part if result is None else result.unionByName(part)
    found = result.groupBy("id", "item").agg(F.max("windows").alias("windows"))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "windows")


def _search(spark, docs: DataFrame, asked: list, words: int, shingle: int, kind: str, item_kind: str) -> DataFrame:
    lengths, hashes = hashed_words([r.t for r in asked])
    item, at, window = windows(lengths, hashes, words)
    result = f"id {kind}, item {item_kind}, windows bigint"
    if not len(item):
        return spark.createDataFrame([], result)
    owner, place, token = windows(lengths, hashes, shingle)
    _, start = np.unique(owner, return_index=True)
    base = np.zeros(len(lengths), np.int64)
    base[np.unique(owner)] = start
    inside = token[(base[item] + at)[:, None] + np.arange(words - shingle + 1)]
    tokens = np.unique(inside)
    known = spark.sparkContext.broadcast(tokens)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                _, _, h = windows(*hashed_words(b.column(0).slice(s, 1024).to_pylist()), shingle)
                where = np.minimum(np.searchsorted(known.value, h), len(known.value) - 1)
                total += np.bincount(where[known.value[where] == h], minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["token", "n"])

    counts = np.zeros(len(tokens), np.int64)
    for r in docs.select("t").mapInArrow(tally, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():  # at most the items' own shingles
        counts[r.token] = r.n
    frequency = counts[np.searchsorted(tokens, inside)]
    rarest = np.lexsort((inside, frequency), axis=1)[:, 0]
    some = frequency.min(1) > 0
    prefix, offset = inside[np.arange(len(inside)), rarest][some], rarest[some]
    starts = np.concatenate([[0], lengths.cumsum()[:-1]])
    content = hashes[(starts[item] + at)[some][:, None] + np.arange(words)]
    order = np.argsort(prefix, kind="stable")
    given = spark.sparkContext.broadcast((prefix[order], offset[order], content[order], item[some][order]))
    names = [r.item for r in asked]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, offset, content, owner = given.value
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                lengths, hashes = hashed_words(b.column(1).to_pylist())
                doc, place, h = windows(lengths, hashes, shingle)
                low = np.searchsorted(prefix, h, "left")
                hit = low < len(prefix)
                hit[hit] = prefix[low[hit]] == h[hit]
                doc, place, low, h = doc[hit], place[hit], low[hit], h[hit]
                n = np.searchsorted(prefix, h, "right") - low
                each = np.repeat(np.arange(len(doc)), n)
                w = low[each] + np.arange(len(each)) - np.repeat(n.cumsum() - n, n)
                begin = place[each] - offset[w]
                bound = (begin >= 0) & (begin + words <= lengths[doc[each]])
                each, w, begin = each[bound], w[bound], begin[bound]
                first = np.concatenate([[0], lengths.cumsum()[:-1]])[doc[each]] + begin
                same = (hashes[first[:, None] + np.arange(words)] == content[w]).all(1) if len(w) else np.zeros(0, bool)
                found = np.stack([doc[each][same], owner[w[same]], begin[same]], 1) if same.any() else np.empty((0, 3), np.int64)
                found = np.unique(found, axis=0)
                pair, n = np.unique(found[:, :2], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pair[:, 0])), pa.array([names[i] for i in pair[:, 1]], item_type), pa.array(n.astype(np.int64))], ["id", "item", "windows"])

    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    return docs.mapInArrow(match, result)
