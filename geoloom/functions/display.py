"""Numbers and places in words, addresses of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import half_up

#: Numbers in words.
ONES = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def shortest(number: Column) -> Column:
    """A number as the shortest text that reads back as it: 44 and not 44.0, 0.0005 and not 5.0E-4, 1e-7 only below a millionth."""
    text = number.cast("string")
    plain = F.regexp_replace(number.cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    small = F.regexp_replace(F.lower(text), r"\.0e", "e")
    return F.when(~F.contains(text, F.lit("E")), F.regexp_replace(text, r"\.0$", "")).when(F.abs(number) < 1e-6, small).otherwise(plain)


def number_words(n: Column) -> Column:
    """Whole numbers from 1 to 99 in words; null for others."""
    ones, tens = (F.array(*[F.lit(w) for w in words]) for words in (ONES, TENS))
    unit, ten = F.get(ones, (n % 10 - 1).cast("int")), F.get(tens, (F.floor(n / 10) - 2).cast("int"))
    return F.when(n.between(1, 19), F.get(ones, (n - 1).cast("int"))).when(n.between(20, 99), F.concat_ws("-", ten, unit))


def plain_fraction(share: Column, most: int = 10) -> Column:
    """struct<gap, whole, part>: the nearest part / whole with whole at most ``most``; the least whole, then part, at a tie."""
    options = [F.struct(F.abs(F.lit(p / w) - share).alias("gap"), F.lit(w).alias("whole"), F.lit(p).alias("part")) for w in range(2, most + 1) for p in range(1, w)]
    return F.array_min(F.array(*options))


def springs_in_words(share: Column) -> Column:
    """A share as a sentence opens: Four springs in five."""
    best = plain_fraction(share)
    lead = number_words(best["part"])
    noun = F.when(best["part"] == 1, " spring in ").otherwise(" springs in ")
    return F.concat(F.upper(F.substring(lead, 1, 1)), F.substring(lead, 2, 20), noun, number_words(best["whole"]))


def elevation(raw: Column) -> Column:
    """Metres, rounded, of a free-text elevation; null where it holds no number."""
    digits = F.regexp_extract(F.regexp_replace(raw, r"[^0-9.\-]", ""), r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    return half_up(digits.try_cast("double")).cast("long")


def source_urls(element: Column, ident: Column, tags: Column) -> Column:
    """The addresses a map element is known by: itself, its sites, its encyclopedia pages."""
    said = lambda k: F.nullif(tags[k], F.lit(""))
    parts = F.split(said("wikipedia"), ":")
    lang, title = F.nullif(F.get(parts, F.lit(0)), F.lit("")), F.nullif(F.get(parts, F.lit(1)), F.lit(""))
    quoted = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(code), F.lit(sign))
    pages = (
        F.concat(F.lit("https://www.openstreetmap.org/"), element, F.lit("/"), ident.cast("string")), said("website"), said("contact:website"),
        F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), quoted), F.concat(F.lit("https://www.wikidata.org/wiki/"), said("wikidata")),
    )
    return F.array_compact(F.array(*pages))


def tile_priority(south: Column, step: float) -> Column:
    """0 for tiles whose middle lies where most springs are, up to 4 for those far south."""
    mid = south + step / 2
    return F.when(mid.between(30, 60), 0).when((mid >= 0) & (mid < 30), 1).when(mid > 60, 2).when(mid >= -30, 3).otherwise(4)
