"""Personal details in free text: found by patterns and by how strongly surroundings reveal them, and replaced."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: words of the kinds of details
TITLES = "Mr|Mrs|Ms|Mx|Miss|Dr|Prof"
STREETS = "street|st|road|rd|avenue|ave|drive|dr|court|ct|place|pl|crescent|cres|terrace|tce|lane|ln|parade|pde|highway|hwy|close|cl|boulevard|blvd|way|grove|gr|circuit|cct|square|sq"
PARTICLES = "de la|van der|van den|von der|de|van|von|da|di|del|der|den|la|le|al|bin|ibn|du|dos|el|ter|mac|st"
MONTHS = "jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december"
UNITS = "unit|flat|apt|apartment|suite|shop|lot|level|villa|townhouse"

EMAIL = re.compile(r"(?<![\w.+-])[\w][\w.+'-]*\s?(?:@|\[at\]|\(at\)|\{at\})\s?[\w-]+(?:(?:\.|\s?[\[({]dot[\])}]\s?|\sdot\s)[\w-]+)+", re.I)
# patterns of numbers begin with one plain class of characters, which the engine finds fast, and look back at it
PHONE = re.compile(r"[+(\d](?<![\w$#/.+-].)(?:(?<=\+)\d{1,3}[ .-]?(?:\(0?\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}|(?<=\()0\d{1,4}\)[ .-]?\d(?:[ .-]?\d){5,8}|(?<=\()\d{3}\)[ .-]?\d{3}[ .-]\d{4}|(?<=0)\d(?:[ .-]?\d){8,9}|(?<=1)[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}|(?<=\d)\d\d[ .-]\d{3}[ .-]\d{4})(?![\w/]|[.-]\d)")
#: runs of six digits and more, whatever they stand for, and the forms that are telephone numbers beyond doubt
_NUMBER = re.compile(r"[+(\d](?<![\w.,/$#-].)(?:(?<=[+(])\d)?(?<=\d)(?:[ .()-]{0,2}\d){5,}(?!\w)")
_SURE_PHONE = re.compile(r"\+|\(0|04\d\d|1[38]00")
IDENTITY = re.compile(
    r"(?<!\w)(?:tax\s+file|tfn|medicare|driver(?:['’]?s)?\s+licen[cs]e|driving\s+licen[cs]e|licen[cs]e|dl(?=\s*[#:.]|\s+n)|passport)(?:\s*(?:\b(?:card|number|num|no|nr|is)\b\.?|[#:.])){0,4}\s*([A-Z]{0,3}\d(?:[ -]?\d){4,11}[A-Z]?)(?!\w|[/.]\d|-\d)", re.I
)
_NAME_WORD = r"[^\W\d_][^\W\d_’'-]*(?:[’'-][^\W\d_]+)*"
#: number, name and type; what may stand before the number is looked at afterwards
ADDRESS = re.compile(rf"[0-9](?<![\w$.,:-].)[0-9]*[A-Z]?(?:-\d+[A-Z]?)? (?!(?:{MONTHS})\b)({_NAME_WORD})(?: ({_NAME_WORD}))??(?: ({_NAME_WORD}))?? (?:{STREETS})(?![\w’'-])", re.I)
_UNIT_BEFORE = re.compile(rf"(?<![\w$/.,:-])(?:(?:{UNITS}|U)\.?\s*\d+[A-Z]?\s?(?:,\s?|/|\s)(?:\d+[A-Z]?/)?|\d+[A-Z]?/)$", re.I)

_T = r"[^\W\d_](?:[’'])?[^\W\d_]+(?:[-’'][^\W\d_]+)*"
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
_CAP = rf"(?=[{_UPPER}])" + _T
_REST = r"(?:[’'])?[^\W\d_]+(?:[-’'][^\W\d_]+)*"
#: given [initial] [particle] family, initial family, or FAMILY, given
# it begins with one plain class of letters, which the engine finds fast
PAIR = re.compile(rf"[{_UPPER}](?<![\w’'@.-].)(?:(?P<family>{_REST}), (?P<given>{_CAP})|(?P<first>{_REST}|\.)(?P<middle>(?: [^\W\d_a-z]\.)*)(?P<particle>(?: (?:{PARTICLES}))*) (?P<last>{_CAP}))(?![\w@]|[’'-]\w)")
_ANY = re.compile(rf"(?:(?P<family>{_T}), (?P<given>{_T})|(?P<first>{_T}|[^\W\d_]\.)(?P<middle>(?: [^\W\d_]\.)*)(?P<particle>(?: (?:{PARTICLES}))*) (?P<last>{_T}))(?![\w@]|[’'-]\w)", re.I)
_TITLE_WORDS = set(TITLES.lower().split("|"))
_TITLE_AT = re.compile(rf"(?:{TITLES})(?<![\w’'-](?:Mr|Ms|Mx|Dr))\.? (?=[a-zà-öø-ÿ])")
_TITLE_END = re.compile(rf"(?:^|(?<![\w’'-]))(?:{TITLES})\.? $", re.I)
_TITLE_LAST = frozenset(".rsxfRSXF")
_DIGITS, _MARKED = re.compile(r"\d+"), re.compile(r"[\d#.,:-]+")


def _left(text: str, at: int, fold: bool) -> str:
    """The two words before a place, a sentence's beginning as ^."""
    words = text[max(0, at - 40) : at].rsplit(None, 2)
    if not words:
        return "^"
    b = words[-1]
    if b[-1] in ".!?" or b == "--" or b == "–":
        return "^"
    a = words[-2] if len(words) > 1 else "^"
    if a[-1] in ".!?":
        a = "^"
    out = f"{a} {b}"
    if not (a.isalpha() and b.isalpha()):
        out = _DIGITS.sub("#", out)
    return out.lower() if fold else out


def _right(text: str, at: int, fold: bool) -> str:
    """The two words (or signs) after a place; digits as #."""
    rest = text[at : at + 40]
    words = rest.split(None, 2)
    if not words or rest[0] in ".!?":
        return "$"
    first = words[0]
    if not (first[0] in "(," and any(map(str.isdigit, first))) and len(words) > 1:
        first = f"{first} {words[1]}"
    out = ("" if rest[0] != " " else " ") + (first if first.isalpha() else _MARKED.sub("#", first))
    return out.lower() if fold else out


def _beside(text: str, at: int) -> str:
    """The word before a number, without case, signs and digits."""
    words = text[max(0, at - 30) : at].rsplit(None, 1)
    return _DIGITS.sub("#", words[-1]).lower().strip(".,;:") if words else "^"


class Span:
    """A possible name; what surrounds it is looked at when asked for."""

    __slots__ = ("text", "start", "end", "given", "last", "fold", "title", "_left")

    def __init__(self, text: str, m: re.Match, fold: bool):
        self.text, self.fold = text, fold
        self.start, self.end = m.span()
        if m.re is PAIR:  # the first letter stands before the groups
            self.given = (m.group("given") or text[self.start : m.end("first")]).lower()
            self.last = (text[self.start : m.end("family")] if m.group("given") else m.group("last")).lower()
        else:
            self.given, self.last = (m.group("given") or m.group("first")).lower(), (m.group("family") or m.group("last")).lower()
        # titles end in one of these letters or a full stop
        before = _TITLE_END.search(text, max(0, self.start - 7), self.start) if text[self.start - 2 : self.start - 1] in _TITLE_LAST else None
        self.title = before is not None
        self._left = before.start() if before else self.start

    @property
    def left(self) -> str:
        return _left(self.text, self._left, self.fold)

    @property
    def right(self) -> str:
        return _right(self.text, self.end, self.fold)


_STREET_WORDS = set(STREETS.split("|"))


def _pairs(text: str, fold: bool = False) -> Iterable[Span]:
    """Name-shaped spans of a text; a title before them isn't a part."""
    at = 0
    while m := PAIR.search(text, at):
        if m.group("first") and text[m.start() : m.end("first")].rstrip(".").lower() in _TITLE_WORDS:
            at = m.end("first") + 1
            continue
        yield Span(text, m, fold)
        after = m.end()
        if m.group("last"):  # what looks like a given name may be a word before an initial
            after = m.start("middle") + 1 if m.group("middle") else m.start("last")
        if fold:
            after = text.find(" ", m.start()) + 1 or m.end()
        at = after if after > m.start() else m.end()


class Evidence:
    """Bits by which a feature of a span raises or lowers the odds that it names a person, from corpus co-occurrence."""

    def __init__(self, given: set[str], family: set[str], bits: dict[tuple[str, str], float]):
        self.given, self.family, self.bits = given, family, bits
        strong = sorted(k.removeprefix("^ ") for (kind, k), v in bits.items() if kind == "L" and v >= 2.5 and k != "^")
        #: cues of names: what reveals one right behind it
        self.cues = re.compile("(?:" + "|".join(map(re.escape, strong)) + ") (?=[a-zà-öø-ÿ])") if strong else None

    def known(self, s: Span) -> tuple[bool, bool]:
        return s.given in self.given, s.last in self.family or any(p in self.family for p in re.split("[-’']", s.last) if len(p) > 2)

    def score(self, s: Span, least: float) -> float:
        """Bits for a person; spans that can't reach ``least`` are given up early."""
        b = self.bits
        first, last = self.known(s)
        bits = 4.0 * s.title + 2.5 * first + 2.5 * last + min(2.0, b.get(("F", s.given), 0.0)) + min(2.0, b.get(("E", s.last), 0.0))
        if bits + 9.5 < least:
            return bits
        return bits + b.get(("L", s.left), -0.5) + b.get(("R", s.right), -0.5)

    def phone(self, text: str, at: int) -> float:
        """Bits for a telephone number: its form, and how strongly the word before it goes with numbers that are one beyond doubt."""
        form = 8.0 if _SURE_PHONE.match(text, at) else 5.0
        return form + max(-6.0, min(2.0, self.bits.get(("P", _beside(text, at)), 0.0)))


_SMALL_WORD, _SMALL_START = re.compile(r"[a-zà-öø-ÿ][^\W\d_]+ "), re.compile(r"[.!?]\s(?=[a-zà-öø-ÿ][^\W\d_]+ )")
_STREET_NEXT = re.compile(rf" (?:{STREETS})(?![\w’'-])", re.I)
_ID_CUES = ("tax", "tfn", "medicare", "licen", "dl", "passport")


def _street_ahead(text: str, s: Span) -> bool:
    return s.last in _STREET_WORDS or bool(_STREET_NEXT.match(text, s.end))


def find_details(text: str, evidence: Evidence, least: float = 4.0) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, found) of every personal detail of a text, in order and without overlap."""
    out: list[tuple[int, int, str, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _, _ in out)

    low = text.lower()
    if "@" in low or "at]" in low or "at)" in low or "at}" in low:
        for m in EMAIL.finditer(text):
            out.append((m.start(), m.end(), "email", m.group().lower()))
    if _DIGITS.search(text):
        for m in IDENTITY.finditer(text) if any(w in low for w in _ID_CUES) else ():
            if free(m.start(1), m.end(1)):
                out.append((m.start(1), m.end(1), "identity", re.sub("[^A-Z0-9]", "", m.group(1).upper())))
        for m in PHONE.finditer(text):
            if free(m.start(), m.end()) and evidence.phone(text, m.start()) >= least:
                out.append((m.start(), m.end(), "phone", re.sub(r"\D", "", m.group())))
        for m in ADDRESS.finditer(text):
            unit = _UNIT_BEFORE.search(text, max(0, m.start() - 30), m.start())
            start = unit.start() if unit else m.start()
            if not unit and text[start - 1 : start] == "/":
                continue
            raised = all(w[0].isupper() for w in m.groups() if w) or _left(text, start, True).split(" ")[-1] in ("at", "to", "is", "outside", "address", "of")
            if raised and free(start, m.end()):
                out.append((start, m.end(), "address", text[start : m.end()]))
    fold = text.isupper()
    scored = []
    for s in _pairs(text, True) if fold else [*_pairs(text), *_cued(text, evidence)]:
        bits = evidence.score(s, least)
        if bits >= least and not _street_ahead(text, s):
            scored.append((-bits, s.start, s.end))
    for _, start, end in sorted(set(scored)):
        if free(start, end):
            out.append((start, end, "name", text[start:end]))
    return sorted(out)


def _cued(text: str, evidence: Evidence) -> Iterable[Span]:
    """Spans in small letters, looked for only behind a title or a cue of names."""
    for m in _TITLE_AT.finditer(text):
        if n := _ANY.match(text, m.end()):
            yield Span(text, n, False)
    for at in ([0] if _SMALL_WORD.match(text) else []) + [m.end() for m in _SMALL_START.finditer(text)]:
        if n := _ANY.match(text, at):
            s = Span(text, n, False)
            if evidence.bits.get(("R", s.right), 0) >= 2:
                yield s
    if evidence.cues is not None:
        for m in evidence.cues.finditer(text):
            if n := _ANY.match(text, m.end()):
                s = Span(text, n, False)
                if evidence.bits.get(("R", s.right), 0) >= 1 or all(evidence.known(s)):
                    yield s


def learn_evidence(df: DataFrame, text_col: str, lexicon: DataFrame, name_col: str = "name", kind_col: str = "kind", share: float = 1e-4, max_lexicon: int = 1_000_000) -> Evidence:
    """Pointwise mutual information of surroundings and words with person names and telephone numbers, counted over the whole corpus.

    Sure telephone numbers (by their form) against all numbers of six digits and more, for the word before them; sure names (behind a title, or a known given name before a known family name) against all name-shaped spans, for the two words on either
    side and for the words themselves. A feature counts from a ``share`` of all spans, so at most 5 / ``share`` features
    reach the driver. The lexicon is a small reference table; past ``max_lexicon`` rows it is refused.
    """
    rows = lexicon.where(F.col(name_col).isNotNull()).select(F.lower(name_col).alias("n"), F.col(kind_col).alias("k")).distinct().limit(max_lexicon + 1).collect()
    if len(rows) > max_lexicon:
        raise ValueError(f"the lexicon has more than {max_lexicon} names")
    given, family = {r.n for r in rows if r.k == "given"}, {r.n for r in rows if r.k == "family"}
    base = df.sparkSession.sparkContext.broadcast((given, family, {}))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(*base.value)
        every: Counter[tuple[str, str]] = Counter()
        sure: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text and not text.isupper():
                    for m in _NUMBER.finditer(text):
                        keys = (("P", _beside(text, m.start())), ("M", ""))
                        for key in keys:
                            every[key] += 1
                        if _SURE_PHONE.match(m.group()):
                            sure.update(keys)
                    for s in _pairs(text):
                        keys = (("L", s.left), ("R", s.right), ("F", s.given), ("E", s.last), ("N", ""))
                        for key in keys:
                            every[key] += 1
                        if s.title or all(evidence.known(s)):
                            sure.update(keys)
            if len(every) > 500_000:
                yield _tally_rows(every, sure)
                every.clear()
                sure.clear()
        yield _tally_rows(every, sure)

    counted = df.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(tally, "kind string, key string, every bigint, sure bigint")
    summed = counted.groupBy("kind", "key").agg(F.sum("every").alias("every"), F.sum("sure").alias("sure")).persist()
    bits: dict[tuple[str, str], float] = {}
    for whole, kinds in (("N", "LRFE"), ("M", "P")):  # of all name-shaped spans, of all long numbers
        total = summed.where(F.col("kind") == whole).first()
        if total is None or not total.sure:
            continue
        rate = total.sure / total.every
        for r in summed.where(F.col("kind").isin(*kinds) & (F.col("every") >= max(2.0, share * total.every))).collect():
            bits[r.kind, r.key] = math.log2((r.sure + 0.5 * rate) / (r.every + 0.5) / rate)
    summed.unpersist()
    return Evidence(given, family, bits)


def _tally_rows(every: Counter, sure: Counter) -> pa.RecordBatch:
    keys = list(every)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.string()), pa.array([every[k] for k in keys], pa.int64()), pa.array([sure[k] for k in keys], pa.int64())], ["kind", "key", "every", "sure"])


def sanitise(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, least: float = 4.0) -> DataFrame:
    """(id, sanitised, details): the text with <EMAIL>, <PHONE>, <IDENTITY>, <ADDRESS> and <NAME> in place of the details, else unchanged.

    ``details`` are the distinct (kind, found) of the row. Null texts stay null and hold no details; null ids are kept;
    repeated rows give repeated rows; extra columns are ignored; an empty table gives no rows. Texts are read whole.

    A name-shaped span is removed if what surrounds it, a title and the lexicon together disclose a person by at least ``least``
    bits, as estimated by corpus co-occurrence; a number if its form and the word before it disclose a telephone. Mail, identity
    numbers and addresses are patterns with their cue words: their form alone discloses them.
    """
    learnt = learn_evidence(df, text_col, lexicon)
    given = df.sparkSession.sparkContext.broadcast((learnt.given, learnt.family, learnt.bits))
    kind = df.schema[id_col].dataType.simpleString()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(*given.value)
        for b in batches:
            texts, details = [], []
            for t in b.column(1).to_pylist():
                if t is None:
                    texts.append(None)
                    details.append([])
                    continue
                found, at, parts = find_details(t, evidence, least), 0, []
                for start, end, what, _ in found:
                    parts += [t[at:start], f"<{what.upper()}>"]
                    at = end
                texts.append("".join(parts) + t[at:])
                details.append([{"kind": k, "found": v} for k, v in dict.fromkeys((k, v) for _, _, k, v in found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(details, pa.list_(pa.struct([("kind", pa.string()), ("found", pa.string())])))], ["id", "sanitised", "details"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(clean, f"id {kind}, sanitised string, details array<struct<kind:string,found:string>>")
    return out.withColumnRenamed("id", id_col)


def personal_details(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, least: float = 4.0) -> DataFrame:
    """(id, kind, found): one row per document and distinct detail; null ids are left out."""
    found = sanitise(df.where(F.col(id_col).isNotNull()), id_col, text_col, lexicon, least)
    return found.select(id_col, F.explode("details").alias("d")).select(id_col, "d.kind", "d.found").distinct()
