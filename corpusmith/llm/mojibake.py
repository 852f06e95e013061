"""Text decoded with a wrong character encoding: found and restored as a noisy channel."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.session import materialise

LOST = "�"
# fixed values: encodings in which UTF-8 bytes are commonly misread, and single-byte pairs (misread as, really)
UTF8_READ_AS = ("cp1252", "cp1251", "cp1250", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "iso8859-2")
SINGLE_BYTE = (("cp1252", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "koi8-r"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1250", "cp1252"), ("cp1252", "cp437"))
# what a run may well have been without being seen elsewhere: letters of Europe's alphabets, signs and typographic characters
_USUAL = frozenset(map(chr, [*range(0xA0, 0x180), *range(0x218, 0x21C), *range(0x384, 0x3CF), *range(0x400, 0x460), 0x490, 0x491, 0x2009, *range(0x200B, 0x200E), *range(0x2010, 0x2016), *range(0x2018, 0x201F), 0x2020, 0x2021, 0x2022, 0x2026, 0x202F, 0x2030, 0x2032, 0x2033, 0x2039, 0x203A, 0x20AC, 0x2116, 0x2122, 0x2212, 0xFEFF]))
_UNSEEN = frozenset("\xa0\xad\u2009\u200b\u200c\u200d\u202f\ufeff")  # not printable, yet quite usual
_OPENING, _INSIDE = frozenset("‚„‹«¡¿§¶†‡‰•ˆ˜"), frozenset("‚„‹«¡¿§¶†‡‰•ˆ˜“”›»…–—‘")
_SPLIT, _RUN = re.compile("[ \t\r\n]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")


_TABLES: dict[str, dict[str, int]] = {}


def byte_table(encoding: str) -> dict[str, int]:
    """Characters of the upper half by byte; an undefined byte shows as the control character of the same number."""
    if encoding in _TABLES:
        return _TABLES[encoding]
    out = {}
    for b in range(128, 256):
        out.setdefault(chr(b) if b < 160 else "", b)
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    out.pop("", None)
    _TABLES[encoding] = out
    return out


def sequences(token: str) -> Iterator[tuple[int, int, str]]:
    """(start, length, character) of every run that is one UTF-8 character misread in one of the encodings: the byte lattice."""
    n = len(token)
    for i in range(n - 1):
        if token[i] < "\x80":
            continue
        seen = set()
        for encoding in UTF8_READ_AS:
            table = byte_table(encoding)
            lead = table.get(token[i], 0)
            size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            if not size or i + size > n:
                continue
            rest = [table.get(c, 0) for c in token[i + 1 : i + size]]
            if all(0x80 <= b <= 0xBF for b in rest):
                try:
                    real = bytes([lead, *rest]).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if (size, real) not in seen:
                    seen.add((size, real))
                    yield i, size, real


def _script(c: str) -> str:
    return "latin" if c < "\u0250" else "greek" if c < "\u0400" else "cyrillic" if c < "\u0530" else "other"


def implausible(token: str, i: int, size: int) -> bool:
    """Whether the run, among the letters beside it, stands as characters don't stand in correct text of any language.

    That is: control characters; letters beside signs, drawing characters, fractions or opening quotes; other punctuation
    between letters; capitals behind small letters; letters of two scripts; a letter and further characters without a letter.
    """
    run = token[i : i + size]
    if any("\x80" <= c <= "\x9f" for c in run) or size > 2 and run[0].isalpha() and not any(c.isalpha() for c in run[1:]):
        return True
    if run[0] == "¬" or "ƒ" in run or run.startswith("‚Ä"):  # signs for other bytes that stand beside nothing here
        return True
    before, after = token[i - 1 : i], token[i + size : i + size + 1]
    window = (before if before.isalpha() else "") + run + (after if after.isalpha() else "")
    for n, (a, b) in enumerate(zip(window, window[1:])):
        if a.isalpha() and b.isalpha():
            if a.islower() and b.isupper() or _script(a) != _script(b):
                return True
            continue
        if not a.isalpha() and not b.isalpha():
            continue
        kind = unicodedata.category(b if a.isalpha() else a)
        if kind in ("So", "Sm", "Sc", "Sk", "No"):
            return True
        if a.isalpha() and (b in _OPENING or b in _INSIDE and window[n + 2 : n + 3].isalpha()):
            return True
    return False


def repair(token: str, chars: dict[str, int], runs: dict[str, int], share: float = 0.5) -> str:
    """The best path through the token's lattice: a run is replaced where its character is that much likelier than the run.

    A run's odds are ``share`` times the corpus count of the character against the count of the run itself, so a quite
    correct sequence of characters, seen as often as it ought to be, stays. Since a source that is misread as a whole may
    outnumber the correct characters, an implausible run that reads as a usual character is replaced whatever the counts, and
    so are runs that touch one. Repeated, for text misread more than once.
    """
    for _ in range(4):
        edges: dict[int, list[tuple[int, str, float]]] = {}
        found = [x for x in sequences(token) if x[2].isprintable() or x[2] in _UNSEEN]
        usual = {(i, i + size) for i, size, real in found if real in _USUAL}
        odd = {(i, j) for i, j in usual if implausible(token, i, j - i)}
        for i, size, real in found:
            beside = token[i - 1 : i] + token[i + size : i + size + 1]
            if real in _USUAL and unicodedata.category(real) in ("Sc", "No") and any(c.isdigit() for c in beside) and not any(c.isalpha() for c in beside):
                odd.add((i, i + size))  # a currency sign or fraction beside a number
        drawn = {i: real for i, size, real in found if size == 2 and real in _USUAL and real.isalpha() and all("\u2500" <= c <= "\u25ff" for c in token[i : i + 2])}
        odd |= {(k, k + 2) for i in drawn if drawn.get(i + 2, "").islower() for k in (i, i + 2)}  # drawing characters that read as a word
        while more := {(i, j) for i, j in usual - odd if any(j == a or i == b for a, b in odd)}:
            odd |= more
        for i, size, real in found:
            gain = math.log(share * chars.get(real, 0) + 1e-9) - math.log(max(runs.get(token[i : i + size], 0), 1))
            if gain >= 0 or real in _USUAL and (i, i + size) in odd:
                edges.setdefault(i, []).append((size, real, max(gain, 1e-4 * math.log1p(chars.get(real, 0))) + 1e-3 * size))
        if not edges:
            return token
        best: list[tuple[float, int, str]] = [(0.0, -1, "")] + [(-1.0, -1, "")] * len(token)
        for i in range(len(token)):
            score = best[i][0]
            if score > best[i + 1][0]:
                best[i + 1] = (score, i, token[i])
            for size, real, gain in edges.get(i, ()):
                if score + gain > best[i + size][0]:
                    best[i + size] = (score + gain, i, real)
        at, parts = len(token), []
        while at:
            _, before, text = best[at]
            parts.append(text)
            at = before
        token = "".join(reversed(parts))
    return token


def special_tokens(text: str | None) -> list[str]:
    return [] if not text or text.isascii() else [w for w in _SPLIT.split(text) if not w.isascii()]


_ENDS = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~0123456789‘’“”„\xab\xbb\xa0"


def core(token: str) -> str:
    """The token without ASCII punctuation at its ends, in lower case."""
    return token.strip(_ENDS).lower()


def lost_edges(body: str) -> list[list[tuple[int, str | None, tuple[int | None, ...] | None, float]]]:
    """By place: (end, character, bytes, weight) of every edge of the lattice of a word with lost bytes.

    A sound character stands for itself and a misread run for its character. A mark is a wildcard: for one whole character, or for one byte
    of a character of two to four, whose other bytes are marks too or show as characters of a wrong encoding.
    """
    out: list[list[tuple[int, str | None, tuple[int | None, ...] | None, float]]] = [[] for _ in body]
    for i, c in enumerate(body):
        out[i].append((i + 1, None, None, -1.0) if c == LOST else (i + 1, c.lower(), None, 0.0))
    for i, size, real in sequences(body):
        out[i].append((i + size, real.lower(), None, -0.5))
    for size in (2, 3, 4):
        for i in range(len(body) - size + 1):
            window = body[i : i + size]
            if LOST not in window or window.isascii():
                continue
            seen = set()
            for encoding in UTF8_READ_AS:
                table = byte_table(encoding)
                known = tuple(None if c == LOST else table.get(c, 0) for c in window)
                lead = known[0]
                width = size if lead is None else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
                if width == size and all(x is None or 0x80 <= x <= 0xBF for x in known[1:]) and known not in seen:
                    seen.add(known)
                    out[i].append((i + size, None, known, -0.7))
    return out


def path_weight(edges: list, word: str) -> float | None:
    """Viterbi: the weight of the best path through the lattice that spells the word; None if there is none."""
    states: list[dict[int, float]] = [{} for _ in range(len(edges) + 1)]
    states[0][0] = 0.0
    for i, here in enumerate(edges):
        for p, score in states[i].items():
            if p == len(word):
                continue
            c = word[p]
            for end, char, known, weight in here:
                if char is not None:
                    fits = char == c
                elif known is None:
                    fits = c > "\x7f"
                else:
                    raw = c.encode("utf-8")
                    fits = c > "\x7f" and len(raw) == len(known) and all(k is None or k == x for k, x in zip(known, raw, strict=True))
                if fits and score + weight > states[end].get(p + 1, -math.inf):
                    states[end][p + 1] = score + weight
    return states[-1].get(len(word))


def certain_letters(body: str, edges: list) -> str:
    """The word with a blank for all but its certain letters: those that no damaged character may cover."""
    open_ = [c == LOST or not c.isalpha() for c in body]
    for i, here in enumerate(edges):
        for end, *_ in here:
            if end > i + 1:
                open_[i:end] = [True] * (end - i)
    return "".join(" " if o else c.lower() if len(c.lower()) == 1 else " " for c, o in zip(body, open_, strict=True))


def lost_keys(token: str) -> list[tuple[str, int]]:
    """(gram, length) of the words that a token with lost bytes may be: up to three certain letters in a row, at each length its lattice allows.

    None if no letter is certain, as nothing then tells words apart.
    """
    body = token.strip(_ENDS)
    edges = lost_edges(body)
    run = max(certain_letters(body, edges).split(), key=len, default="")
    lengths: list[set[int]] = [set() for _ in range(len(body) + 1)]
    lengths[0].add(0)
    for i, here in enumerate(edges):
        for end, *_ in here:
            lengths[end] |= {n + 1 for n in lengths[i]}
    return [(run[:3], n) for n in sorted(lengths[-1])] if run else []


def word_keys(word: str) -> list[tuple[str, int]]:
    """The keys under which a sound word is found: every run of up to three of its characters, with its length."""
    return [(g, len(word)) for g in sorted({word[i : i + k] for k in (1, 2, 3) for i in range(len(word) - k + 1)})]


def fitting(body: str, words: list[tuple[str, int]]) -> list[tuple[float, str]]:
    """(weight of the best path plus logarithm of the corpus count, word) of the words that the lattice spells, best first."""
    edges = lost_edges(body)
    sure = certain_letters(body, edges)
    head, tail = re.match("[^ ]*", sure).group(), re.search("[^ ]*$", sure).group()
    return sorted(((w + math.log(n), word) for word, n in words if word.startswith(head) and word.endswith(tail) and (w := path_weight(edges, word)) is not None), key=lambda x: (-x[0], x[1]))


def choose(body: str, scored: list[tuple[float, str]], odds: float) -> str | None:
    """The best word; where under two letters are certain, only if it is ``odds`` times likelier than the next."""
    sure = sum(c.isascii() and c.isalpha() for c in body) or sum(c != " " for c in certain_letters(body, lost_edges(body)))
    if not scored or sure < 2 and len(scored) > 1 and scored[0][0] - scored[1][0] < math.log(odds):
        return None
    return scored[0][1]


def put_word(token: str, word: str) -> str:
    """The token with the word in its place, in the letters' case."""
    body = token.strip(_ENDS)
    letters = [c for c in body if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        word = word.upper()
    elif letters and letters[0].isupper() and body[0] != LOST:
        word = word[0].upper() + word[1:]
    at = token.index(body)
    return token[:at] + word + token[at + len(body) :]


def fill_lost(token: str, words: list[tuple[str, int]], odds: float = 8.0) -> str | None:
    """The token with its lost bytes restored: the word with the highest weight of its best path plus the logarithm of its corpus count.

    Where under two letters are certain, that word must also be ``odds`` times likelier than the next.
    """
    body = token.strip(_ENDS)
    word = choose(body, fitting(body, words), odds) if body else None
    return None if word is None else put_word(token, word)


def reread(token: str) -> list[str]:
    """Other readings of a token with lost bytes under the swapped single-byte encodings; the marks stay."""
    out = []
    for wrong, right in SINGLE_BYTE:
        table = byte_table(wrong)
        try:
            read = "".join(c if c <= "\x7f" or c == LOST else bytes([table[c]]).decode(right) for c in token)
        except (KeyError, UnicodeDecodeError):
            continue
        if read != token and _RUN.fullmatch(core(read).replace(LOST, "").replace("-", "").replace("’", "").replace("'", "")):
            out.append(read)
    return list(dict.fromkeys(out))


def token_damage(df: DataFrame, id_col: str, text_col: str, least: int = 3, odds: float = 8.0) -> DataFrame:
    """(token, restored, way): every damaged token of the corpus.

    ``restored`` is null where nothing fits, and still holds marks where only other damage of the token could be put right.
    """
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(special_tokens(t))
            if len(found) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"])
                found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    tokens = materialise(texts.mapInArrow(collect, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")))

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, bool]] = Counter()
        for b in batches:
            for token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for c in token:
                    if c > "\x7f":
                        total[c, False] += n
                for i, size in {(i, size) for i, size, _ in sequences(token)}:
                    total[token[i : i + size], True] += n
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([r for _, r in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], ["key", "run", "n"])

    chars, runs = {}, {}
    # bounded by the number of Unicode characters and their misread forms, not by the corpus
    for r in tokens.mapInArrow(statistics, "key string, run boolean, n bigint").groupBy("key", "run").agg(F.sum("n").alias("n")).collect():
        (runs if r.run else chars)[r.key] = r.n
    given = df.sparkSession.sparkContext.broadcast((chars, runs))

    def readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, runs = given.value
        rows: list[tuple] = []
        for b in batches:
            for token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fixed = repair(token, chars, runs)
                if fixed != token:
                    rows.append((token, n, core(token), "utf8", fixed, None, False))
                if LOST in fixed:
                    rows.append((token, n, core(token), "lost", fixed, core(fixed), True))
                    rows += [(token, n, core(token), "lost, read anew", read, core(read), True) for read in reread(token)]
                else:
                    own = core(token)
                    if fixed == token:
                        rows.append((token, n, own, "as is", token, own, False))
                    for wrong, right in SINGLE_BYTE:
                        table = byte_table(wrong)
                        try:
                            read = bytes(table[c] if c > "\x7f" else ord(c) for c in token).decode(right)
                        except (KeyError, UnicodeDecodeError):
                            continue
                        word = core(read)
                        if len(word) > 2 and not word.isascii() and _RUN.fullmatch(word.replace("-", "").replace("’", "").replace("'", "")) and read != token:
                            rows.append((token, n, own, f"{wrong} for {right}", read, word, False))
            yield _reading_rows(rows)
            rows = []

    shape = "token string, n bigint, own string, way string, restored string, word string, lost boolean"
    read = materialise(tokens.mapInArrow(readings, shape))
    words = read.where("way = 'as is'").groupBy(F.col("own").alias("word")).agg(F.sum("n").alias("seen")).where("word <> ''")
    sure = read.where("way = 'utf8'").select("token", "restored", "way")
    single = read.where("not lost and way not in ('as is', 'utf8')").select("token", "own", "way", "restored", "word")
    known = single.join(words.select("word", "seen"), "word").join(words.select(F.col("word").alias("own"), F.col("seen").alias("as_is")), "own", "left")
    better = known.where((F.col("seen") >= least) & (F.col("seen") >= odds * F.coalesce("as_is", F.lit(0))))
    best = Window.partitionBy("token").orderBy(F.desc("seen"), "way")
    swapped = better.withColumn("r", F.row_number().over(best)).where("r = 1").select("token", "restored", "way")
    # a word with lost bytes meets the sound words that are alike but for their runs of other characters than ASCII; without an ASCII letter, those with
    # the same run of certain letters and a length that fits
    frame = F.regexp_replace("word", "[^\\x00-\\x7f]+", LOST)
    lost = read.where("lost").select("token", "way", "restored", "word").distinct()
    latin = F.col("word").rlike("[a-z]")

    def keyed(keys) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [[f"{n} {g}" for g, n in keys(x)] for x in b.column(0).to_pylist()]
                at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns], pa.array([k for x in found for k in x], pa.string())], [*b.schema.names, "frame"])

        return run

    asked = lost.where(latin).select("restored", "token", "way", frame.alias("frame")).unionByName(lost.where(~latin).select("restored", "token", "way").mapInArrow(keyed(lost_keys), "restored string, token string, way string, frame string"))
    sound = words.where(latin).select("word", "seen", frame.alias("frame")).unionByName(words.where(~latin).select("word", "seen").mapInArrow(keyed(word_keys), "word string, seen bigint, frame string"))

    def search(key: tuple, tokens: pa.Table, known: pa.Table) -> pa.Table:
        pairs, rows = list(zip(known["word"].to_pylist(), known["seen"].to_pylist(), strict=True)), []
        for t, body, way in zip(tokens["token"].to_pylist(), tokens["restored"].to_pylist(), tokens["way"].to_pylist(), strict=True):
            # the two best words are enough; a token read anew is that much less likely
            rows += [(t, body, score - math.log(odds) * (way != "lost"), word) for score, word in (fitting(body.strip(_ENDS), pairs)[:2] if pairs else [])]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("token", "restored", "score", "word"), columns, (pa.string(), pa.string(), pa.float64(), pa.string()), strict=True)})

    found = asked.groupBy("frame").cogroup(sound.join(asked.select("frame").distinct(), "frame", "left_semi").groupBy("frame")).applyInArrow(search, "token string, restored string, score double, word string")
    ranked = found.groupBy("token", "word").agg(F.min(F.struct((-F.col("score")).alias("minus"), "restored")).alias("x"))
    best_two = ranked.groupBy("token").agg(F.slice(F.array_sort(F.collect_list(F.struct("x.minus", "word", "x.restored"))), 1, 2).alias("best"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, fixed, best in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                word = choose(best[0]["restored"].strip(_ENDS), [(-x["minus"], x["word"]) for x in best], odds) if best else None
                # what is certain of a token is put right even if its lost bytes stay open
                out.append(put_word(best[0]["restored"], word) if word is not None else fixed if fixed != t else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(["lost"] * len(out), pa.string())], ["token", "restored", "way"])

    filled = lost.where("way = 'lost'").select("token", "restored").join(best_two, "token", "left").mapInArrow(fill, "token string, restored string, way string")
    sure = sure.where(~F.col("restored").contains(LOST)).join(swapped.select("token"), "token", "left_anti")  # a known word is the better reading
    every = sure.unionByName(swapped).unionByName(filled)
    return materialise(every)


def _reading_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["token", "n", "own", "way", "restored", "word", "lost"])


def damaged_documents(df: DataFrame, id_col: str, text_col: str, damage: DataFrame | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """(id, tokens): the documents that hold damaged tokens, with the tokens and what they were.

    Null ids and texts take no part; texts are read whole; extra columns are ignored; empty input: empty result. Repeated
    rows of an id are taken together.

    All tokens with characters beyond ASCII are read as noisy transmissions: a byte lattice of the UTF-8 characters that a
    run may have been under each wrong encoding (repeatedly, for text misread twice), searched with Viterbi under the
    corpus counts of characters and runs and the implausibility of runs; readings of the whole token under swapped single-byte encodings, weighed by
    corpus word counts; and lost bytes as wildcards in the lattice, filled with the word whose best path and corpus count together weigh
    most. The word counts and lattices are worked out once a distinct token. Up to ``broadcast_rows`` damaged tokens are sent to the documents, so that
    frequent sound tokens needn't be shuffled; more are joined.
    """
    damage = token_damage(df, id_col, text_col) if damage is None else damage
    if damage.limit(broadcast_rows + 1).count() <= broadcast_rows:
        damage = F.broadcast(damage)
    kind = df.schema[id_col].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = list(dict.fromkeys(special_tokens(t)))
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.string())], ["id", "token"])

    held = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(explode, f"id {kind}, token string")
    hit = held.join(damage, "token").groupBy("id").agg(F.collect_set(F.struct("token", "restored", "way")).alias("tokens"))
    return hit.withColumnRenamed("id", id_col)


def restore_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored, damaged, unresolved): texts of the damaged documents with every restorable token put right."""
    found = damaged_documents(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    both = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("_t")).join(found, id_col).select(F.col(id_col).alias("id"), "_t", F.to_json(F.col("tokens"), {"ignoreNullFields": "false"}).alias("tokens"))

    def put_right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            out, hurt, open_ = [], [], []
            for t, tokens in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                to = {x["token"]: x["restored"] for x in json.loads(tokens)}
                parts = re.split("([ \t\r\n]+)", t)
                hurt.append(sum(p in to for p in parts))
                open_.append(sum(p in to and (to[p] is None or LOST in to[p]) for p in parts))
                out.append("".join(to.get(p) or p for p in parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(hurt, pa.int32()), pa.array(open_, pa.int32())], ["id", "restored", "damaged", "unresolved"])

    return both.mapInArrow(put_right, f"id {kind}, restored string, damaged int, unresolved int").withColumnRenamed("id", id_col)
