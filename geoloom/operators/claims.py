"""Claims against the pages they cite: numbers word for word, everything else to a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import densest_window, value_appears

#: Claimable fields whose value must stand in the source as a number.
NUMBER_FIELDS = (
    "temperature.celsius", "temperature.fahrenheit", "location.elevation", "minerals.ph", "minerals.tds", "minerals.sulfate", "minerals.bicarbonate",
    "minerals.chloride", "minerals.calcium", "minerals.magnesium", "minerals.sodium", "minerals.potassium", "minerals.silica", "minerals.iron",
)
#: Outcomes of a fetch that may pass; verdicts.
PASSING = ("source-unreachable", "source-too-large")
REFUTED, UNREACHABLE, NEEDS_REVIEW, VERIFIED = "refuted", "unreachable", "needs-semantic-review", "verified"
DISPUTED = "disputed"
#: Characters of a note and of an excerpt.
NOTE_CHARS, EXCERPT_CHARS = 280, 6000
#: Words that mark the part of a page that decides a field.
FIELD_WORDS = {
    "clothing.policy": ("swimwear", "swimsuit", "bathing suit", "attire", "dress code", "clothing", "nude", "topless"),
    "clothing.schedule": ("swimwear", "swimsuit", "clothing-optional", "dress code", "schedule"),
    "clothing.notes": ("swimwear", "swimsuit", "attire", "dress code", "clothing"),
    "temperature.kind": ("emerges", "source", "spring water", "heated", "pool temperature", "kept at", "degrees"),
    "access.price": ("price", "fee", "admission", "rate", "ticket", "cost", "adult", "child"),
    "access.currency": ("price", "fee", "admission", "rate", "ticket", "cost"),
    "access.notes": ("access", "entry", "admission", "parking", "reservation"),
    "hours.open": ("hours", "open", "opening", "closed", "daily", "schedule"),
    "hours.status": ("hours", "open", "opening", "closed", "season"),
    "hours.seasonalNotes": ("season", "hours", "closed", "winter", "summer", "holiday"),
    "minerals.notes": ("mineral", "composition", "analysis", "water quality", "mg/l", "dissolved"),
    "minerals.types": ("mineral", "composition", "sulphur", "sulfur", "chloride", "bicarbonate", "spring quality"),
    "minerals.measuredAt": ("analysis", "analysed", "analyzed", "tested", "sampled"),
    "description": ("about", "history", "overview"),
    "location.region": ("region", "province", "state", "county"),
    "location.nearestTown": ("town", "village", "city", "near"),
    "name": ("name", "known as"),
}


def verify(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, field, verdict, detail) of the active claims.

    ``claims``: id, field, value, source, state; ``pages``: one row a url (url,
    outcome, body), as fetched before.  A claim whose page is not there is
    unreachable, one without a field needs review.  Only claims that need a page meet them.
    """
    active = claims.where("state is null or state = '' or state = 'active'")
    literal = F.coalesce(F.col("field").isin(*NUMBER_FIELDS), F.lit(False))
    review = active.where(~literal).select("id", "field", F.lit(NEEDS_REVIEW).alias("verdict"), F.concat(F.coalesce("field", F.lit("null")), F.lit(" is not a value that appears verbatim in a source; a reader must judge it")).alias("detail"))
    met = active.where(literal).join(pages, F.col("source") == F.col("url"), "left").withColumn("outcome", F.coalesce("outcome", F.lit("source-unreachable")))
    fetched, found = F.col("outcome") == "ok", value_appears(F.col("value").try_cast("double"), F.coalesce("body", F.lit("")))
    verdict = F.when(~fetched & F.col("outcome").isin(*PASSING), UNREACHABLE).when(fetched & found, VERIFIED).otherwise(REFUTED)
    detail = F.when(~fetched, F.col("outcome")).when(~found, F.concat(F.lit("value-absent-from-source: "), F.col("value"), F.lit(" does not appear at "), F.col("source")))
    return met.select("id", "field", verdict.alias("verdict"), detail.alias("detail")).unionByName(review)


def summary(results: DataFrame) -> DataFrame:
    """One row: how many results each verdict has, and the exit code that the worst of them gives."""
    n = {v: F.count_if(F.col("verdict") == v) for v in (REFUTED, DISPUTED, UNREACHABLE, NEEDS_REVIEW, VERIFIED)}
    code = F.when(n[REFUTED] > 0, 1).when(n[DISPUTED] > 0, 3).when(n[UNREACHABLE] > 0, 2).otherwise(0)
    return results.agg(*[c.alias(v.replace("needs-semantic-review", "needs_review")) for v, c in n.items()], code.alias("code"))


def source_excerpt(text: Column, value: Column, most: int = EXCERPT_CHARS) -> Column:
    """A window around the first place that says the value, with a decimal point or comma; else the head."""
    low, raw = F.lower(text), F.lower(value)
    spots = [F.nullif(F.instr(low, v), F.lit(0)) for v in (raw, F.regexp_replace(raw, r"^([^.]*)\.", "$1,"), F.regexp_replace(raw, r"^([^,]*),", "$1."))]
    at = F.coalesce(*spots, F.lit(1))
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, F.greatest(F.lit(1), at - most // 2), F.lit(most)))


def field_excerpt(text: Column, field: Column, most: int = EXCERPT_CHARS) -> Column:
    """struct<text, at, matched, score>: the window of ``most`` characters where the words of the field are densest.

    Each place of a word proposes a window around it; the first of the most
    places wins, word by word.  A text that fits is taken whole, with its
    first word found and score 0; one without any word gives its head.  Null
    text counts as empty; a field without words finds none.
    """
    table = F.create_map(*[x for name, words in FIELD_WORDS.items() for x in (F.lit(name), F.array(*[F.lit(w) for w in words]))])
    words = F.coalesce(F.try_element_at(table, field), F.array().cast("array<string>"))
    return densest_window(F.coalesce(text, F.lit("")), words, F.lit(most))


def strip_note(note: Column) -> Column:
    """A foreign note as plain words: no links, tags, angles, addresses or mentions; null becomes ''."""
    out = F.coalesce(note, F.lit(""))
    steps = ((r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?i)</?[a-z][^>]*>", ""), ("[<>]", ""), (r"(?i)\bhttps?://\S+", ""), (r"(^|\s)[@#][\w-]+", "$1"), (r"\s+", " "))
    for pattern, instead in steps:
        out = F.regexp_replace(out, pattern, instead)
    return F.substring(F.trim(out), 1, NOTE_CHARS)


def search_query(value: Column, most: int = 300) -> Column:
    """A query without leading dashes and with single blanks; null where nothing is left or it is too long."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(value, r"(^|\s)[-−–]+", "$1"), r"\s+", " "))
    return F.when((clean != "") & (F.length(clean) <= most), clean)
