"""Texts packed into sequences of a fixed number of tokens, by minimum bin slack."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_tokenizer(ranks: bytes):
    """A byte-pair encoding from the content of a rank file."""
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: how these rank files split text before merging
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens, hash) of every row with an id and a text; the text is tokenised whole. The rank file is read here and sent to the workers."""
    given = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kind = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(given.value).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64()), b.column(2)], ["id", "tokens", "hash"])

    some = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("hash"))
    return some.mapInArrow(count, f"id {kind}, tokens bigint, hash bigint")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of the available lengths whose sum comes nearest to ``room`` from below.

    Subset sums as bits of one integer; each length enters in powers of two of its count, the longest first, and the search
    ends as soon as the room can be filled exactly.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            wider = (reach | (reach << (length * times))) & mask
            if wider != reach:
                steps.append((length, times, reach))
                reach = wider
                if reach >> room & 1:
                    break
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            used[length] = used.get(length, 0) + times
    return list(used.items())


def minimum_slack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. Each bin starts with the longest item left and takes the fullest combination of the rest."""
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_length.setdefault(n, []).append(i)
    for items in by_length.values():
        items.reverse()
    counts, bins = {n: len(v) for n, v in by_length.items()}, []
    order = sorted(by_length, reverse=True)
    while order:
        longest = order[0]
        counts[longest] -= 1
        chosen = fullest({n: c for n, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        need = dict(chosen)
        need[longest] = need.get(longest, 0) + 1
        repeat = min(counts[n] // k for n, k in need.items())
        for _ in range(repeat):  # the same combination stays the fullest as long as its lengths last
            bins.append([by_length[n].pop() for n, k in need.items() for _ in range(k)])
        for n, k in need.items():
            counts[n] -= k * repeat
            if not counts[n]:
                del counts[n]
        order = [n for n in order if n in counts]
    return bins


def pack_sequences(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, shard_items: int = 20_000, tokenizer: str = TOKENIZER) -> DataFrame:
    """(sequence, position, id, start, tokens): where each text's tokens go; every sequence holds at most ``capacity`` tokens.

    A text longer than ``capacity`` is cut into full sequences and a rest, which is packed like a short text; no other is
    cut. Null texts and ids and texts without tokens give no rows. Each row is an item of its own, even if ids or texts
    repeat. Extra columns are ignored; empty input: empty result.

    Items are dealt by hash to shards of about ``shard_items``, each packed by one task by minimum bin slack; only the last
    few sequences of a shard have room left, so the loss falls with the shard size.
    """
    kind = df.schema[id_col].dataType.simpleString()
    counted = materialise(token_counts(df, id_col, text_col, tokenizer).where("tokens > 0"))
    shards = max(1, -(-counted.count() // shard_items))
    # rows that are the same in all are interchangeable and numbered, a thousand at a time; so the same rows are packed alike wherever they lie
    alike = counted.groupBy("id", "hash", "tokens").agg(F.count("*").alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1000).cast("bigint"))).alias("k"))
    items = alike.select("id", "hash", "tokens", F.explode(F.sequence(F.col("k") * 1000, F.least(F.col("n"), (F.col("k") + 1) * 1000) - 1)).alias("copy"))
    full = items.where(F.col("tokens") >= capacity).select("id", "hash", "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("tokens") / capacity).cast("bigint") - 1)).alias("j"))
    whole = full.select(F.concat_ws("_", F.lit("full"), F.hex("hash"), "copy", "j").alias("sequence"), F.lit(0).alias("position"), "id", (F.col("j") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("tokens"))
    rest = items.select("id", "hash", "copy", (F.col("tokens") - F.col("tokens") % capacity).alias("start"), (F.col("tokens") % capacity).alias("tokens")).where("tokens > 0")
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("hash", "copy"), F.lit(shards)).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("tokens", "descending"), ("id", "ascending"), ("hash", "ascending"), ("copy", "ascending")])
        shard = group["shard"][0].as_py()
        bins = minimum_slack(group["tokens"].to_pylist(), capacity)
        at = [i for b in bins for i in b]
        picked = group.take(pa.array(at, pa.int64()))
        names = [f"shard_{shard}_{k}" for k, b in enumerate(bins) for _ in b]
        return pa.table({"sequence": names, "position": pa.array([p for b in bins for p in range(len(b))], pa.int32()), "id": picked["id"], "start": picked["start"], "tokens": picked["tokens"]})

    packed = dealt.groupBy("shard").applyInArrow(pack, f"sequence string, position int, id {kind}, start bigint, tokens bigint")
    return whole.unionByName(packed).withColumnRenamed("id", id_col)
