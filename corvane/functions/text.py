"""Text expressions: tokens, stemming, word counts, HTML escaping, highlights and snippets.

Everything here is a Column expression, so it runs inside the JVM and can be
pushed, pruned and fused by the optimizer.
"""

from __future__ import annotations

import html
import html.entities
import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.scratch import join_groups, unused, written

#: ASCII letters and digits, in runs that single hyphens and underscores may join.
TOKEN = r"[a-zA-Z0-9]+(?:[_\-][a-zA-Z0-9]+)*"

# The stopwords. Those with an apostrophe can't match a token; they count for callers' own tokens.
STOPWORDS = tuple(
    """
    a about above after again against all am an and any are aren't as at be because been before being below between
    both but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from
    further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his
    how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor
    not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should
    shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd
    they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were
    weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you
    you'd you'll you're you've your yours yourself yourselves
    """.split()
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column) -> Column:
    """All tokens of the text, in order, as they stand."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def terms(text: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Lower-cased tokens without stopwords."""
    lowered = F.transform(matches(text), F.lower)
    stop = list(stopwords)
    return F.filter(lowered, lambda t: ~t.isin(stop)) if stop else lowered


# --- Porter's stemmer (1980) ------------------------------------------------------------------------------------
# The published conditions on the part before a suffix, as expressions over letters. A y is a vowel after a consonant.
_START = r"^(?:[aeiou]|[^aeiou][^aeiouy]*[aeiouy])"
_ROUND = r"[aeiou]*[^aeiou][^aeiouy]*"
HAS_VOWEL = _START
MEASURE_OVER_0 = _START + r"[aeiou]*[^aeiou]"
MEASURE_OVER_1 = _START + _ROUND + r"[aeiouy][aeiou]*[^aeiou]"
MEASURE_IS_1 = _START + _ROUND + r"(?:[aeiouy][aeiou]*)?$"
CVC = r"^(?:[aeiou]+[^aeiou][^aeiouy]*|[^aeiou][^aeiouy]*)(?:[aeiouy][aeiou]*[^aeiou][^aeiouy]*)*[aeiouy][^aeiouwxy]$"
DOUBLE_CONSONANT = r"([^aeiouy])\1$|(?:(?:^|[aeiou])y(?:yy)+|[^aeiouy](?:yy)+)$"

# The suffixes of steps 2, 3 and 4, in the order in which they are tried.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.char_length(word) - n)


def _first_suffix(word: Column, rules: Sequence[tuple[str, str]], condition: str, otherwise: Column) -> Column:
    """The first suffix that the word ends with is replaced if what stands before meets the condition."""
    out = otherwise
    for suffix, new in reversed(rules):
        stem = _cut(word, len(suffix))
        out = F.when(word.endswith(suffix), F.when(stem.rlike(condition), F.concat(stem, F.lit(new))).otherwise(word)).otherwise(out)
    return out


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)


def _mend(w: Column) -> Column:
    """After -ed or -ing has gone: restore an e, or undouble the last consonant."""
    return (
        F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e")))
        .when(w.rlike(DOUBLE_CONSONANT) & ~w.rlike("[lsz]$"), _cut(w, 1))
        .when(w.rlike(MEASURE_IS_1) & w.rlike(CVC), F.concat(w, F.lit("e")))
        .otherwise(w)
    )


def _past(w: Column) -> Column:
    def gone(n: int) -> Column:
        return F.when(_cut(w, n).rlike(HAS_VOWEL), let(_cut(w, n), _mend)).otherwise(w)

    return F.when(w.endswith("eed"), F.when(_cut(w, 3).rlike(MEASURE_OVER_0), _cut(w, 1)).otherwise(w)).when(w.endswith("ed"), gone(2)).when(w.endswith("ing"), gone(3)).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, 1).rlike(HAS_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _step_4(w: Column) -> Column:
    ion = F.when(w.rlike("[st]ion$") & _cut(w, 3).rlike(MEASURE_OVER_1), _cut(w, 3)).otherwise(w)
    return _first_suffix(w, [(s, "") for s in STEP_4], MEASURE_OVER_1, ion)


def _final_e(w: Column) -> Column:
    stem = _cut(w, 1)
    return F.when(w.endswith("e") & (stem.rlike(MEASURE_OVER_1) | (stem.rlike(MEASURE_IS_1) & ~stem.rlike(CVC))), stem).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MEASURE_OVER_1), _cut(w, 1)).otherwise(w)


def stem(word: Column) -> Column:
    """Porter's stem of a token. Tokens of one or two characters stay."""
    steps = [_plural, _past, _final_y, lambda w: _first_suffix(w, STEP_2, MEASURE_OVER_0, w), lambda w: _first_suffix(w, STEP_3, MEASURE_OVER_0, w), _step_4, _final_e, _final_l]
    out = F.lower(word)
    for step in steps:
        out = let(out, step)
    return F.when(F.char_length(word) <= 2, F.lower(word)).otherwise(out)


def with_stems(rows: DataFrame, word_col: str, stem_col: str) -> DataFrame:
    """``rows`` with the stem of a word, worked out once for each distinct word.

    The vocabulary is written with the rows of each word; the commonest words
    are joined by broadcast, so no task gets all rows of one.
    """
    (n,) = unused([word_col, stem_col], "n")
    counted = rows.groupBy(word_col).agg(F.count("*").alias(n))
    vocabulary = written(counted.withColumn(stem_col, stem(F.col(word_col))), "vocabulary")
    return join_groups(rows, vocabulary, word_col, n).drop(n)


def exploded_tokens(docs: DataFrame, id_col: str, text_col: str, stopwords: Iterable[str] = STOPWORDS, stemming: bool = True) -> DataFrame:
    """(id, position, normalized, stemmed) for every token that isn't a stopword."""
    each = docs.select(F.col(id_col), F.posexplode(terms(F.col(text_col), stopwords)).alias("position", "normalized"))
    return with_stems(each, "normalized", "stemmed") if stemming else each.withColumn("stemmed", F.col("normalized"))


def token_offsets(docs: DataFrame, id_col: str, text_col: str, stopwords: Iterable[str] = STOPWORDS, stemming: bool = True) -> DataFrame:
    """(id, position, raw, normalized, stemmed, start_char, end_char): tokens and the characters they stand at.

    Offsets are running sums of the lengths of the tokens and of what stands
    between them; positions count tokens that aren't stopwords.
    """
    text, stop = F.coalesce(F.col(text_col), F.lit("")), list(stopwords)
    parts = F.arrays_zip(matches(text).alias("raw"), F.slice(F.split(text, TOKEN, -1), F.lit(1), F.size(matches(text))).alias("gap"))
    each = docs.select(F.col(id_col), F.posexplode(parts).alias("i", "p")).select(id_col, "i", F.col("p.raw").alias("raw"), F.char_length("p.gap").alias("gap"))
    order = Window.partitionBy(id_col).orderBy("i")
    ends = each.withColumn("end_char", F.sum(F.col("gap") + F.char_length("raw")).over(order).cast("int"))
    kept = ends.withColumn("normalized", F.lower("raw")).where(~F.col("normalized").isin(stop) if stop else F.lit(True))
    named = kept.withColumns({"position": F.row_number().over(order) - 1, "start_char": F.col("end_char") - F.char_length("raw")})
    stemmed = with_stems(named, "normalized", "stemmed") if stemming else named.withColumn("stemmed", F.col("normalized"))
    return stemmed.select(id_col, "position", "raw", "normalized", "stemmed", "start_char", "end_char")


# --- words and HTML ---------------------------------------------------------------------------------------------
def words(text: Column) -> Column:
    """Whitespace-separated words, as str.split() gives them."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def escape_html(text: Column) -> Column:
    """& < > and both quotes as references."""
    out = text
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(reference))
    return out


def strip_tags(text: Column) -> Column:
    """The text without tags and blanks around it."""
    return stripped(F.regexp_replace(text, "<[^>]+>", ""))


#: A reference as browsers read one: numeric, or a name that need not end in a semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names with what they stand for, from the standard table; names that count without a semicolon; numbers that stand for other characters.
_NAMED = json.dumps(html.entities.html5)
_LEGACY = "^(?:" + "|".join(sorted((x for x in html.entities.html5 if not x.endswith(";")), key=len, reverse=True)) + ")"
_MOVED = json.dumps({str(code): html.unescape(f"&#{code};") for code in (0, 13, *range(128, 160))})


def _numbered(piece: Column) -> Column:
    """The character of a numeric reference: U+FFFD for what is none, nothing for control characters and non-characters."""
    hexadecimal = piece.rlike("^&#[xX]")
    digits = F.regexp_replace(F.regexp_replace(piece, "^&#[xX]?0*|;$", ""), "^$", "0")
    code = F.when(F.char_length(digits) > 8, F.lit(0x110000)).when(hexadecimal, F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))

    def character(c: Column) -> Column:
        control = c.between(1, 8) | (c == 11) | c.between(14, 31) | (c == 127) | c.between(0xFDD0, 0xFDEF) | ((c % 0x10000) >= 0xFFFE)
        plain = F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        moved = F.try_element_at(F.from_json(F.lit(_MOVED), "map<string, string>"), c.cast("string"))
        return F.when(c.between(0xD800, 0xDFFF) | (c > 0x10FFFF), "\ufffd").when(moved.isNotNull(), moved).when(control, "").otherwise(plain)

    return let(code, character)


def _named(piece: Column) -> Column:
    """What a named reference stands for; the longest known name that it begins with, if there is one."""
    name = F.substring(piece, F.lit(2), F.char_length(piece))
    names = F.from_json(F.lit(_NAMED), "map<string, string>")
    known = F.regexp_extract(name, _LEGACY, 0)
    rest = F.substring(name, F.char_length(known) + 1, F.char_length(name))
    return F.coalesce(F.try_element_at(names, name), F.when(known != "", F.concat(F.try_element_at(names, known), rest)), piece)


def unescape_html(text: Column) -> Column:
    """All references of HTML decoded, named and numeric, each once and as browsers do it.

    The text is split at its references and put together again; only texts
    that have an ampersand do the work.
    """

    def decoded(whole: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(whole, F.lit(REFERENCE), F.lit(0)), lambda p: F.when(p.startswith("&#"), _numbered(p)).otherwise(_named(p)))
        return F.array_join(F.zip_with(F.split(whole, REFERENCE, -1), pieces, lambda gap, piece: F.concat(gap, F.coalesce(piece, F.lit("")))), "")

    return F.when(F.contains(text, F.lit("&")), let(text, decoded)).otherwise(text)


def stripped(text: Column) -> Column:
    """The text without white space at both ends, as str.strip() gives it."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def highlight(text: Column, query_terms: Column) -> Column:
    """The escaped text, with each whole word that is one of the terms (longer than one character) in a mark element."""
    kept = F.filter(F.transform(query_terms, F.trim), lambda t: F.char_length(t) > 1)
    quoted = F.transform(kept, lambda t: F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?iU)\b("), F.array_join(quoted, "|"), F.lit(r")\b"))
    escaped = escape_html(text)
    return F.when(F.size(kept) == 0, escaped).otherwise(F.regexp_replace(escaped, pattern, F.lit('<mark class="highlight">$1</mark>')))


def snippet(text: Column, query_terms: Column, window: int = 40, step: int = 5) -> Column:
    """The window of words with the most query terms (the first of several), marked, with dots where it is cut.

    Empty for empty and null texts; whole texts of at most ``window`` words.
    """
    wanted = F.transform(F.filter(query_terms, lambda t: F.char_length(t) > 1), F.lower)

    def cut(all_words: Column) -> Column:
        n = F.size(all_words)
        bare = F.transform(all_words, lambda w: F.lower(F.regexp_replace(w, r"(?U)\W+", "")))
        hits = F.transform(bare, lambda w: F.array_contains(wanted, w).cast("int"))

        def best(h: Column) -> Column:
            starts = F.sequence(F.lit(0), n - window, F.lit(step))
            scored = F.transform(starts, lambda i: F.struct(F.aggregate(F.slice(h, i + 1, F.lit(window)), F.lit(0), lambda a, x: a + x).alias("score"), (-i).alias("back")))
            return -F.array_max(scored)["back"]

        start = F.when(F.size(wanted) == 0, 0).otherwise(let(hits, best))

        def around(at: Column) -> Column:
            body = F.array_join(F.slice(all_words, at + 1, F.lit(window)), " ")
            return F.concat(F.when(at > 0, "...").otherwise(""), body, F.when((at + window < n) | (F.size(wanted) == 0), "...").otherwise(""))

        return F.when(n <= window, text).otherwise(let(start, around))

    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(highlight(let(words(text), cut), query_terms))
