"""Names and evidence in text, as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say nothing about which spring is meant.
GENERIC_WORDS = ("hot", "warm", "spring", "springs", "the")
#: Words that alone make no name to agree with, and the qualifiers one source leaves out.
NO_NAME_WORDS = ("hot", "warm", "spring", "springs", "pool", "pools", "the", "and", "of")
QUALIFIERS = r"(?i)\b(hot|warm)\b"
#: What may stand between a digit and a range's dash; the dashes that are signs.
UNIT_BEFORE_DASH = " ?°? ?[cfk]?"
DASHES = "[-\u2212\u2013]"


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    import unicodedata

    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StructType().add("text", "string").add("at", "integer").add("matched", "string").add("score", "integer"))
def densest_window(texts: pd.Series, words: pd.Series, most: pd.Series) -> pd.DataFrame:
    """The window of ``most`` characters with the most places of the words, as ``claims.field_excerpt`` says."""
    from bisect import bisect_left

    def places(low: str, word: str):
        at = low.find(word)
        while at >= 0:
            yield at
            at = low.find(word, at + 1)

    def window(text: str, own, size: int) -> tuple:
        low = text.lower()
        if len(text) <= size:
            return text, 0, next((w for w in own if w in low), None), 0
        hits = [(at, w) for w in own for at in places(low, w)]
        spots = sorted(at for at, _ in hits)
        best = (0, None, 0)
        for at, word in hits:
            start = max(0, min(at - size // 2, len(text) - size))
            held = bisect_left(spots, start + size) - bisect_left(spots, start)
            if best[1] is None or held > best[2]:
                best = (start, word, held)
        return text[best[0] : best[0] + size], *best

    return pd.DataFrame([window(*row) for row in zip(texts, words, most, strict=True)], columns=["text", "at", "matched", "score"])


def norm_name(name: Column, ascii_only: bool = False) -> Column:
    """Lower case, letters and digits of any script only; null becomes ''.

    Names are put into NFKC first; ``ascii_only`` promises that this changes
    nothing and keeps the expression in the JVM.
    """
    name = F.coalesce(name, F.lit(""))
    return F.regexp_replace(F.lower(name if ascii_only else nfkc(name)), r"[^\p{L}\p{N}]+", "")


def identity_name(name: Column) -> Column:
    """The words of a name without generic ones, joined by blanks."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*GENERIC_WORDS)), " ")


def _only_generic(name: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*NO_NAME_WORDS))


def _either_holds(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def names_agree(a: Column, b: Column, ascii_only: bool = False) -> Column:
    """Whether two names may be one place's.

    A blank name agrees with all; one that holds the other agrees; otherwise a
    name of generic words alone agrees with none, and the rest are compared once
    more without "hot" and "warm".
    """
    x, y = norm_name(a, ascii_only), norm_name(b, ascii_only)
    short = [norm_name(F.regexp_replace(F.coalesce(n, F.lit("")), QUALIFIERS, " "), ascii_only) for n in (a, b)]
    bare = (short[0] != "") & (short[1] != "") & _either_holds(*short)
    return F.when((x == "") | (y == "") | _either_holds(x, y), True).when(_only_generic(a) | _only_generic(b), False).otherwise(bare)


def html_text(html: Column) -> Column:
    """Visible text: no script, style, noscript or template bodies, tags as blanks, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?(</\1\s*>|\z)", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    # "&amp;" last: what it makes is no entity
    for entity, sign in (("&nbsp;", " "), ("&deg;", "°"), ("&amp;", "&")):
        text = F.regexp_replace(text, f"(?i){entity}", sign)
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}\x{3000}]+", " "))


def number_pattern(value: Column) -> Column:
    """A pattern that finds a number as a whole, in lower-cased text.

    A dot may be followed by trailing zeros, a decimal comma may not; whole
    numbers may be grouped by threes.  A dash before it is a sign unless a digit,
    maybe with its unit, stands before the dash, as in a range.
    """
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(34,12)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    parts = F.split(plain, r"\.")
    grouped = F.regexp_replace(parts[0], r"(?<=[0-9])(?=([0-9]{3})+$)", "[.,]?")
    body = F.when(F.size(parts) > 1, F.concat(parts[0], F.lit(r"(?:\."), parts[1], F.lit("0*|,"), parts[1], F.lit(")"))).otherwise(F.concat(grouped, F.lit(r"(?:\.0+)?")))
    return F.concat(F.lit(rf"(?<![0-9.,])(?<!(?<![0-9]{UNIT_BEFORE_DASH}){DASHES})"), body, F.lit(r"(?![0-9.,]*[0-9])"))


def value_appears(value: Column, text: Column) -> Column:
    """Whether the number stands in the text; one that is not finite never does."""
    finite = ~F.isnan(value) & (F.abs(value) < 1e21)
    return F.coalesce(finite & F.rlike(F.lower(text), number_pattern(value)), F.lit(False))


def word_appears(word: Column, text: Column) -> Column:
    """Whether the word stands in the text, in any case, with no ASCII letter or digit beside it; a blank word never does."""
    word = F.trim(F.lower(word))
    quoted = F.regexp_replace(word, r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    return F.coalesce((word != "") & F.rlike(F.lower(text), F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))), F.lit(False))


def one_line(text: Column) -> Column:
    """Tabs and line ends as blanks, for TSV."""
    return F.regexp_replace(text, "[\t\r\n]+", " ")
