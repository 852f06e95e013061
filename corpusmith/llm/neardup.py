"""Near-duplicate texts: an exact join over prefixes of the rarest shingles, sieved by bounds, with an exact check; and signatures from thrown darts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.common import connected_components
from corpusmith.llm.shingles import distinct, hashed_words, mix, once, windows
from corpusmith.session import materialise

_SLAB = 4.0  # height of a rank region
_ROUTES, _ROUTE = 6, 50_000  # groups of shingles at least; more from so many texts a group on
_STEP = 1 << 20  # pairs sieved at a time


def _poisson_steps(mean: float) -> np.ndarray:
    p, total, out = np.exp(-mean), 0.0, []
    for k in range(64):
        total += p
        out.append(total)
        p *= mean / (k + 1)
    return np.array(out)


_STEPS = _poisson_steps(_SLAB)


def throw(doc: np.ndarray, item: np.ndarray, shared: np.ndarray, docs: int, k: int) -> np.ndarray:
    """(docs, k) dart ids: in each of ``k`` coordinates the dart of lowest rank that hit one of the text's items; 0 for a text without items.

    The ranks over each item are cut into slabs; the number of darts in a slab and their places depend only on item and
    slab, so equal items see equal darts, and two texts agree in a coordinate with the probability of their Jaccard
    similarity. Slab after slab is thrown, and a dart counts if it hits a coordinate that was empty before its slab, until a text has none
    left. The lowest bit of an id tells whether its item is ``shared``. Items of a text must be distinct: repeats throw the same
    darts again. ``doc`` ascends.
    """
    step = np.uint64(0xD6E8FEB86659FD93)  # the j-th dart of a region is drawn from region + j times an odd constant
    sig, least, empty = np.zeros(docs * k, np.uint64), np.full(docs * k, 0xFFFFFFFF, np.uint32), np.ones(docs * k, bool)
    empty.reshape(docs, k)[np.bincount(doc, minlength=docs) == 0] = False
    slab = 0
    while len(doc):
        region = mix(item + mix(np.full(1, slab, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        n = np.searchsorted(_STEPS, (region >> np.uint64(11)) / 2.0**53)
        ends = n.cumsum()
        dart = np.arange(int(ends[-1]), dtype=np.uint64)
        dart *= step
        dart += np.repeat(region - (ends - n).astype(np.uint64) * step, n)
        dart = mix(dart)
        where = dart & np.uint64(0xFFFFFFFF)
        where *= np.uint64(k)
        where >>= np.uint64(32)
        where = where.view(np.int64)
        where += np.repeat(doc * k, n)
        hit = np.flatnonzero(empty[where])
        at, rank = where[hit], (dart[hit] >> np.uint64(32)).astype(np.uint32)
        np.minimum.at(least, at, rank)
        won = hit[rank == least[at]]
        owner = np.searchsorted(ends, won, side="right")
        sig[where[won]] = (dart[won] | np.uint64(3)) ^ (~shared[owner]).astype(np.uint64)
        empty[at] = False
        left = empty.reshape(docs, k).any(1)[doc]
        doc, item, shared = doc[left], item[left], shared[left]
        slab += 1
    return sig.reshape(docs, k)


def _set_keys(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's set of shingles; equal sets have equal ones."""
    keys = np.zeros((2, docs), np.uint64)
    if len(doc):
        at, start = np.unique(doc, return_index=True)
        keys[0, at], keys[1, at] = mix(np.add.reduceat(mix(h), start)), mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), start))
    return keys[0].view(np.int64), keys[1].view(np.int64)


def _reach(size: np.ndarray, share: float) -> np.ndarray:
    """How many of a set's entries must be looked at so that one of any ``share`` of them is met."""
    return size - np.maximum(np.ceil(share * size - 1e-6), 1).astype(np.int64) + 1


def _sketches(doc: np.ndarray, h: np.ndarray, docs: int, words: int) -> np.ndarray:
    """(docs, 2 x words) 32-bit words: bits that each item of a set flips. Two sets differ in at least as many items as their sketches in bits."""
    bits = words * 64
    at = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)
    odd = np.bincount(doc * bits + at, minlength=docs * bits) & 1
    return np.packbits(odd.astype(bool).reshape(docs, bits), axis=1).view(np.uint32)


def index_entries(doc: np.ndarray, h: np.ndarray, level: np.ndarray, least: float, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, text, entry) of the shingles in each text's prefix, ordered by part, text and place.

    A text's shingles are put in order of ``level`` and hash, the same order for all texts; two sets at least as similar as ``least`` have
    a shingle in common among the first ``1 - least`` of each and one more. An entry has 24 bits of the shingle's hash, 7 for its place as a share of the
    set's size (rounded down) and one that is set in a text's first entry of a part. At most 2048 texts; ``doc`` ascends.
    """
    size = np.bincount(doc)
    both = np.sort(doc.astype(np.uint64) << np.uint64(53) | level.astype(np.uint64) << np.uint64(43) | h >> np.uint64(21))
    place = np.arange(len(doc)) - (size.cumsum() - size)[doc]
    near = place < _reach(size, least)[doc]
    doc, place, token = doc[near], place[near], mix(both[near] & np.uint64((1 << 43) - 1))
    part = ((token >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    part, doc, place, token = part[order], doc[order], place[order], token[order]
    first = np.ones(len(doc), bool)
    first[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    entry = (token & np.uint64(0xFFFFFF)).astype(np.uint32) << np.uint32(8) | (place * 128 // size[doc]).astype(np.uint32) << np.uint32(1) | first.astype(np.uint32)
    return part, doc, entry


def sieve(head: np.ndarray, entry: np.ndarray, least: float) -> np.ndarray:
    """(pairs, 2) names, smaller first, of the texts that may be at least as similar as ``least``: those that have a shingle of both prefixes in
    common and whose sizes, places in the prefixes and sketches allow it. No pair that is as similar fails a bound.

    ``head``: name, size and sketch of each text; ``entry``: as ``index_entries`` makes them, text by text.
    """
    _, kept, same = np.unique(_folded(head), return_index=True, return_inverse=True)  # copies came from several batches
    owner = np.cumsum(entry & np.uint32(1)).astype(np.int64) - 1
    held = kept[same[owner]] == owner
    owner, entry = same[owner[held]], entry[held]
    head = head[kept]
    name, size, sketch = head[:, 0].astype(np.int64), head[:, 1].astype(np.int64), np.ascontiguousarray(head[:, 2:]).view(np.uint64)
    most = (1 << 24) - 1
    by = (entry >> np.uint32(8)).astype(np.int64) << 24 | np.minimum(size, most)[owner]
    order = np.argsort(by)
    by, owner, entry = by[order], owner[order], entry[order]
    own = size[owner]
    place = -(-(own * (entry >> np.uint32(1) & np.uint32(127)).astype(np.int64)) // 128)
    rest = own - place  # of the set from here on
    # the smaller set of a pair has the first common shingle in a shorter prefix; its partners stand behind it
    small = np.flatnonzero(place < _reach(own, 2 * least / (1 + least)))
    last = np.searchsorted(by, by[small] >> 24 << 24 | np.minimum(np.floor(own[small] / least + 1e-6).astype(np.int64), most), side="right")
    many = last - small - 1
    small, many = small[many > 0], many[many > 0]
    total = np.concatenate([[0], many.cumsum()])
    needed, apart = least / (1 + least), (1 - least) / (1 + least)
    found, fresh, i = np.empty(0, np.int64), [], 0
    while i < len(small):
        j = max(i + 1, int(np.searchsorted(total, total[i] + _STEP, side="right")) - 1)
        left = np.repeat(small[i:j], many[i:j])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[i:j] - total[i], many[i:j])
        both = own[left] + own[right]
        ok = np.flatnonzero(np.minimum(rest[left], rest[right]) >= needed * both - 1e-6)
        x, y, both = owner[left[ok]], owner[right[ok]], both[ok]
        ok = (np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= apart * both + 1e-6) & (x != y)
        x, y = x[ok], y[ok]
        fresh.append(np.unique(np.minimum(x, y) * len(name) + np.maximum(x, y)))
        if sum(map(len, fresh)) > max(len(found), 4 * _STEP):
            found, fresh = np.unique(np.concatenate([found, *fresh])), []
        i = j
    found = np.unique(np.concatenate([found, *fresh]))
    a, b = name[found // max(len(name), 1)], name[found % max(len(name), 1)]
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)


def _folded(rows: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row of 32-bit words."""
    out = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        out = mix(out + column.astype(np.uint64) + np.uint64(1))
    return out


class _Reader:
    """The distinct hashed shingles of the texts with at least ``min_words`` words; others have none."""

    def __init__(self, width: int, min_words: int):
        self.width, self.min_words = width, min_words

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        lengths, hashes = hashed_words(texts)
        doc, _, h = windows(lengths, hashes, self.width)
        enough = lengths[doc] >= self.min_words
        return once(doc[enough], h[enough])


@dataclass
class NearDuplicates:
    members: DataFrame  # id, class: the smallest id with the same set of shingles
    links: DataFrame  # a, b, similarity: classes (a < b) at least as similar as asked


def near_duplicates(df: DataFrame, id_col: str, text_col: str, least: float = 0.8, width: int = 5, min_words: int = 1, filter_bits: int = 1 << 25) -> NearDuplicates:
    """Texts whose sets of ``width``-word shingles have a Jaccard similarity of at least ``least``.

    Words are the longest runs of a-z and 0-9 in the lower-cased text. Null, blank and shorter texts (under ``min_words`` or
    ``width`` words) and null ids take no part. Repeated rows of an id count once; if its texts differ, one counts.
    Texts with equal sets form one class, so copies cost nothing beyond their row in ``members``. Extra columns are ignored;
    empty input gives empty results. Whole texts are used, of any length.

    Nothing that meets the threshold is left out, except where hashes coincide: shingles are compared by 64 bits (43 in the prefixes, 48 in the check). Shingles are
    counted by hash in cells whose number follows the mean length of the texts (at most 2^20), which puts them in an order from rare
    to frequent; a text sends the entries of its prefix (``1 - least`` of its set and one), dealt to groups by shingle, and once a group its size and a sketch.
    Pairs with a common entry are sieved there by bounds on sizes, places and sketches. They grow with the square of the texts that share a
    shingle, hence with the square of a corpus of one kind. What is left is checked on the whole sets (of 48-bit hashes); only candidates' sets travel.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    source = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    mean = source.agg(F.avg(F.length("t"))).first()[0] or 0.0
    bits = int(np.clip(np.ceil(np.log2(max(mean, 1.0) / 6 * 2000)), 16, 20))  # about six letters a word
    sketch = int(np.clip(np.ceil(max(mean, 1.0) / 6 * 3.5 / 64), 2, 16))  # 64-bit words; three instead of four leave 17 times the pairs at 76 shingles a text
    cells, shift = 1 << bits, np.uint64(64 - bits)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, counters, n = _Reader(width, min_words), np.zeros(cells, np.int32), 0
        for b in batches:
            doc, h = read(b.column(1).to_pylist())
            at = np.unique(doc)
            k1, k2 = _set_keys(doc, h, b.num_rows)
            single = np.zeros(b.num_rows, bool)  # copies count once a batch, else a much copied text would seem boilerplate
            single[at[np.unique(k1[at], return_index=True)[1]]] = True
            counters += np.bincount((h[single[doc]] >> shift).astype(np.int64), minlength=cells).astype(np.int32)
            n += int(single.sum())
            none = pa.nulls(len(at))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(k1[at]), pa.array(k2[at]), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary())], ["id", "k1", "k2", "chunk", "n", "counts"])
        # shingle statistics travel as chunks of counters that are added up by the workers
        chunks = counters.reshape(16, -1)
        none = pa.nulls(16)
        empty = b.schema.field(0).type if n else None
        if n:
            yield pa.RecordBatch.from_arrays([none.cast(empty), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(range(16), pa.int32()), pa.array([n] + [0] * 15, pa.int64()), pa.array([c.tobytes() for c in chunks], pa.binary())], ["id", "k1", "k2", "chunk", "n", "counts"])

    surveyed = materialise(source.mapInArrow(survey, f"id {kind}, k1 bigint, k2 bigint, chunk int, n bigint, counts binary"))

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in group["counts"].to_pylist())
        return pa.table({"chunk": group["chunk"][:1], "n": pa.array([sum(group["n"].to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    added = surveyed.where("chunk is not null").select("chunk", "n", "counts").groupBy("chunk").applyInArrow(add, "chunk int, n bigint, counts binary").collect()  # 16 rows of fixed size
    counters, n = np.zeros((16, cells // 16), np.int64), 0
    for r in added:
        counters[r.chunk], n = np.frombuffer(r.counts, np.int64), n + r.n
    levels = spark.sparkContext.broadcast(np.floor(16 * np.log2(1 + counters.ravel())).astype(np.uint16))  # of 10 bits
    parts = int(min(1 << 16, max(_ROUTES, n // _ROUTE)))

    ids = surveyed.where("chunk is null").groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("k"))
    classes = ids.groupBy("k").agg(F.min("id").alias("class"))
    members = materialise(ids.join(classes, "k").select("id", "class", F.col("k.k1").alias("k1")))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader(width, min_words)
        for whole in batches:
            heads: list[list[bytes]] = [[] for _ in range(parts)]
            entries: list[list[bytes]] = [[] for _ in range(parts)]
            for b in (whole.slice(s, 2048) for s in range(0, whole.num_rows, 2048)):
                doc, h = read(b.column(0).to_pylist())
                key, _ = _set_keys(doc, h, b.num_rows)
                some = np.unique(doc)
                _, first = np.unique(key[some], return_index=True)
                chosen = np.zeros(b.num_rows, bool)
                chosen[some[first]] = True  # copies within a batch are sent once
                keep = chosen[doc]
                doc, h = doc[keep], h[keep]
                head = np.empty((b.num_rows, 2 + 2 * sketch), np.uint32)
                head[:, 0], head[:, 1], head[:, 2:] = key.view(np.uint64) & np.uint64(0xFFFFFFFF), np.bincount(doc, minlength=b.num_rows), _sketches(doc, h, b.num_rows, sketch)
                part, text, entry = index_entries(doc, h, levels.value[(h >> shift).astype(np.int64)], least, parts)
                first = np.flatnonzero(entry & np.uint32(1))
                tops = np.searchsorted(part[first], np.arange(parts + 1))
                ends = np.searchsorted(part, np.arange(parts + 1))
                for r in np.flatnonzero(ends[1:] > ends[:-1]):
                    heads[r].append(head[text[first[tops[r] : tops[r + 1]]]].tobytes())
                    entries[r].append(entry[ends[r] : ends[r + 1]].tobytes())
            held = [r for r in range(parts) if heads[r]]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *(pa.array([b"".join(x[r]) for r in held], pa.binary()) for x in (heads, entries))], ["part", "heads", "entries"])

    def collide(group: pa.Table) -> pa.Table:
        head, entry = (np.frombuffer(b"".join(group[c].to_pylist()), np.uint32) for c in ("heads", "entries"))
        pairs = sieve(head.reshape(-1, 2 + 2 * sketch), entry, least)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    packed = source.select("t").mapInArrow(index, "part int, heads binary, entries binary")
    pairs = packed.groupBy("part").applyInArrow(collide, "a bigint, b bigint").distinct()
    short = members.where(F.col("id") == F.col("class")).select(F.col("k1").bitwiseAND(F.lit(0xFFFFFFFF)).alias("short"), "class")
    named = pairs.join(short.select(F.col("short").alias("a"), F.col("class").alias("x")), "a").join(short.select(F.col("short").alias("b"), F.col("class").alias("y")), "b")
    candidates = materialise(named.where("x <> y and (a < b or x < y)").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))

    wanted = _bitmap(candidates.select("x").union(candidates.select("y")), "x", filter_bits)
    asked = spark.sparkContext.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader(width, min_words)
        for b in batches:
            at = b.column(2).to_numpy() % filter_bits
            b = b.filter(pa.array(asked.value[at >> 3] >> (at & 7) & 1 == 1))
            doc, h = distinct(*read(b.column(1).to_pylist()))
            held, start = np.unique(doc, return_index=True)
            kept = (h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            ends = np.append(start, len(h)) * 6
            k1, k2 = (k[held] for k in _set_keys(doc, h, b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(held)), pa.array(k1), pa.array(k2), pa.array([kept[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["id", "k1", "k2", "s"])

    held = source.select("id", "t", F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1)).alias("h")).mapInArrow(sets, f"id {kind}, k1 bigint, k2 bigint, s binary").groupBy("id").agg(F.min(F.struct("k1", "k2", "s")).alias("k")).select("id", F.col("k.s").alias("s"))  # the text that gave the class

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(s, 16384) for whole in batches for s in range(0, whole.num_rows, 16384)):
            (n, p), (m, q) = _numbered(b.column(2)), _numbered(b.column(3))
            # both are in order, by pair and then by hash
            at = np.minimum(np.searchsorted(p, q), max(len(p) - 1, 0))
            both = np.bincount((q >> np.uint64(48)).astype(np.int64)[p[at] == q] if len(p) else [], minlength=b.num_rows)
            similar = both / np.maximum(n + m - both, 1)
            held = np.flatnonzero(both >= least * (n + m - both) - 1e-9)
            keep = pa.array(held)
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(similar[held])], ["a", "b", "similarity"])

    first = candidates.join(held.select(F.col("id").alias("x"), F.col("s").alias("p")), "x")
    both = first.join(held.select(F.col("id").alias("y"), F.col("s").alias("q")), "y").select("x", "y", "p", "q")
    links = materialise(both.mapInArrow(verify, f"a {kind}, b {kind}, similarity double"))
    return NearDuplicates(members.select("id", "class"), links)


def _numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of hashes of each row, all 48-bit hashes with the row's number, at most 16 bits, above them)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    n = np.diff(offsets) // 6
    wide = np.zeros((int(n.sum()), 8), np.uint8)
    if len(wide):
        wide[:, :6] = np.frombuffer(column.buffers()[2], np.uint8, len(wide) * 6, int(offsets[0])).reshape(-1, 6)
    return n, wide.view(np.uint64).ravel() | np.repeat(np.arange(len(column), dtype=np.uint64) << np.uint64(48), n)


def _bitmap(df: DataFrame, col: str, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits with the hashes of a column; only this fixed size reaches the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[b.column(0).to_numpy() % size] = True
        parts = np.packbits(bits.reshape(64, -1), axis=1, bitorder="little")
        held = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([parts[i].tobytes() for i in held], pa.binary())], ["part", "bits"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["bits"].to_pylist()])
        return pa.table({"part": group["part"][:1], "bits": pa.array([total.tobytes()], pa.binary())})

    got = df.select(F.xxhash64(col).bitwiseAND(F.lit((1 << 62) - 1)).alias("h")).mapInArrow(fill, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary").collect()
    out = np.zeros((64, size // 512), np.uint8)
    for r in got:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def duplicate_pairs(found: NearDuplicates, block: int = 1000) -> DataFrame:
    """(a, b) of all documents, a < b: links between classes expanded over their members, and copies among themselves.

    A class of more than ``block`` copies is cut into parts, so that no task makes more than a part's pairs with another part;
    ``duplicate_groups`` gives one row a document instead.
    """
    m, links = found.members, found.links
    if not m.groupBy("class").count().where(F.col("count") > block).limit(1).count():
        across = links.join(m.select(F.col("class").alias("a"), F.col("id").alias("i")), "a").join(m.select(F.col("class").alias("b"), F.col("id").alias("j")), "b")
        copies = m.select(F.col("class").alias("c"), F.col("id").alias("i")).join(m.select(F.col("class").alias("c"), F.col("id").alias("j")), "c").where("i < j")
        return across.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).union(copies.select("i", "j"))
    parts = m.groupBy("class").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    cut = m.join(parts, "class").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = cut.select(F.col("class").alias("c"), F.col("part").alias("p"), every.alias("q"), F.col("id").alias("i"))
    right = cut.select(F.col("class").alias("c"), every.alias("p"), F.col("part").alias("q"), F.col("id").alias("j"))
    copies = left.join(right, ["c", "p", "q"]).where("i < j")
    # across: each member of a by its part, each member of b by its own
    near = links.join(parts.select(F.col("class").alias("a"), F.col("parts").alias("pa")), "a").join(parts.select(F.col("class").alias("b"), F.col("parts").alias("pb")), "b")
    near = near.select("a", "b", "pb", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)).alias("p")).select("a", "b", "p", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("q"))
    across = near.join(cut.select(F.col("class").alias("a"), F.col("part").alias("p"), F.col("id").alias("i")), ["a", "p"]).join(cut.select(F.col("class").alias("b"), F.col("part").alias("q"), F.col("id").alias("j")), ["b", "q"])
    return across.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).union(copies.select("i", "j"))


def duplicate_groups(found: NearDuplicates) -> DataFrame:
    """(id, group, links): each document's group (its smallest id) and number of linked other texts; without partner none.

    ``links`` counts the classes of other texts it is linked to; documents of one class share them.
    """
    part = connected_components(found.links, "a", "b")
    degree = found.links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    named = found.members.join(part.withColumnRenamed("node", "class"), "class", "left").join(degree, "class", "left")
    named = named.select("id", F.coalesce("component", "class").alias("c"), F.coalesce("links", F.lit(0)).alias("links"))
    first = named.groupBy("c").agg(F.min("id").alias("group"), F.count("*").alias("k")).where("k > 1")
    return named.join(first, "c").select("id", "group", "links")
