"""Text expressions: words, normalising, acronyms, similarity of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]{2,}"
TOKEN = r"[\p{L}\p{N}_&]+"
PARTS = r"[\p{L}\p{N}_&]+|[^\p{L}\p{N}_&]+"

# fixed values: common English function words
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they "
    "this those through to too under until up very was we were what when where which while who whom why will with would you your yours"
).split()
# fixed values: words for numbers
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
# fixed values: irregular English forms
IRREGULAR = {"was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "has": "have", "had": "have", "did": "do", "went": "go", "gone": "go", "men": "man", "women": "woman", "children": "child", "feet": "foot", "said": "say", "found": "find", "held": "hold", "left": "leave", "moved": "move", "drove": "drive"}


# fixed values: consonants that English doubles before -ing and -ed
DOUBLED = "(bb|dd|gg|mm|nn|pp|rr|tt)"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased words of two letters, digits or underscores and more; null counts as empty."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(pattern), F.lit(0))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    trimmed = F.regexp_replace(text_or_empty(text), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def strip_punctuation(text: Column) -> Column:
    """Punctuation as blanks; symbols such as $ and + stay."""
    return F.regexp_replace(text, r"\p{P}+", " ")


def number_like(word: Column) -> Column:
    return word.rlike(r"^[+-]?[0-9][0-9.,/]*$") | word.isin(NUMBER_WORDS)


def lemma(word: Column) -> Column:
    """A small table of irregular forms, then suffix rules (running, planned: run, plan); other words stay as they are."""
    rules = (
        F.when(word.rlike("[a-z]{2}ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(sses|shes|ches|xes)$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike(f"[a-z]{{2}}{DOUBLED}ing$"), F.regexp_replace(word, "[a-z]ing$", ""))
        .when(word.rlike(f"[a-z]{{2}}{DOUBLED}ed$"), F.regexp_replace(word, "[a-z]ed$", ""))
        .when(word.rlike("[a-z]{3}ing$"), F.regexp_replace(word, "ing$", ""))
        .when(word.rlike("[a-z]{3}ed$"), F.regexp_replace(word, "ed$", ""))
        .when(word.rlike("[a-z]{2}[^su]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )
    out = F.when(word == "was", F.lit("be"))
    for form, base in IRREGULAR.items():
        if form != "was":
            out = out.when(word == form, F.lit(base))
    return out.otherwise(rules)


def stop_words(custom: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> list[str]:
    """Default and own stop words without those to keep."""
    return sorted((set(STOP_WORDS) | {w.lower() for w in custom}) - {w.lower() for w in keep})


def normalize(text: Column, lowercase: bool = True, remove_punctuation: bool = True, remove_numbers: bool = False, lemmatize: bool = True, remove_stop_words: bool = True, custom: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> Column:
    """The text's words joined by single blanks after the chosen steps; null gives an empty text."""
    out = text_or_empty(text)
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = strip_punctuation(out)
    tokens = F.filter(F.split(out, r"\s+"), lambda w: w != "")
    if remove_numbers:
        tokens = F.filter(tokens, lambda w: ~number_like(w))
    if remove_stop_words:
        stop = stop_words(custom, keep)
        tokens = F.filter(tokens, lambda w: ~F.lower(w).isin(stop))
    if lemmatize:
        tokens = F.transform(tokens, lemma)
    return F.array_join(tokens, " ")


def acronyms(text: Column, min_length: int = 2) -> Column:
    """All acronyms of a text in order: tokens of capitals, digits and & that start with a capital."""
    tokens = F.regexp_extract_all(text_or_empty(text), F.lit(TOKEN), F.lit(0))
    return F.filter(tokens, lambda w: w.rlike("^[A-Z][A-Z0-9&]{" + str(min_length - 1) + ",}$"))


def similarity(a: Column, b: Column) -> Column:
    """0..100 from the edit distance and the longer word's length."""
    return F.round(100.0 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))), 4)


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def replace_tokens(text: Column, mapping: Column) -> Column:
    """Tokens found in the map give way to their values; everything between stays."""
    parts = F.regexp_extract_all(text_or_empty(text), F.lit(PARTS), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(mapping, w), w)), "")


def literal_map(pairs: dict[str, str]) -> Column:
    if not pairs:
        return F.create_map(F.lit(""), F.lit(""))
    return F.create_map(*[F.lit(x) for k in sorted(pairs) for x in (k, pairs[k])])
