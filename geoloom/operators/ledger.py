"""The ledger of reviews: what was spent, and who may spend more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Claims of a review, of an author's day, and of everybody's day.
REVIEW_CAP, AUTHOR_CAP, TOTAL_CAP = 25, 30, 100


def midnight(now: Column) -> Column:
    """The start of the day in the session's time zone, which should be UTC."""
    return F.date_trunc("day", now)


def spent_since(ledger: DataFrame, prefix: str, since: Column) -> Column:
    """An aggregate over ``ledger`` (key, at, claims): the claims, not the rows, of a prefix since then; undated entries don't count."""
    counts = F.col("key").startswith(prefix) & (F.col("at") >= since)
    return F.coalesce(F.sum(F.when(counts, F.coalesce("claims", F.lit(0)))), F.lit(0))


def eligible(requests: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """``requests`` (pr, sha, author, claims) with ``verdict``: ok, or the first rule that refuses.

    In order: the commit was reviewed; the review is too large; the author's day or everybody's day would be
    overspent.  Each request is judged by itself, against the ledger (key, at, claims) alone.  Keys are
    ``review/<pr>/<sha>`` and ``author/<author>/<pr>/<sha>``.
    """
    since = midnight(now)
    author = F.regexp_extract("key", "^author/([^/]*)/", 1)
    mine = ledger.where(F.col("key").startswith("author/") & (F.col("at") >= since)).groupBy(author.alias("author")).agg(F.coalesce(F.sum("claims"), F.lit(0)).alias("_mine"))
    total = ledger.agg(spent_since(ledger, "review/", since).alias("t")).first()["t"]
    key = F.concat_ws("/", F.lit("review"), F.col("pr").cast("string"), "sha")
    done = ledger.select(F.col("key").alias("_key")).distinct()
    claims = F.coalesce("claims", F.lit(0))
    both = requests.withColumn("_want", key).join(done, F.col("_want") == F.col("_key"), "left").join(mine, "author", "left")
    verdict = (
        F.when(F.col("_key").isNotNull(), "already reviewed").when(claims > REVIEW_CAP, F.concat(F.lit("too many claims ("), claims.cast("string"), F.lit(f" > {REVIEW_CAP})")))
        .when(F.coalesce("_mine", F.lit(0)) + claims > AUTHOR_CAP, "author cap").when(F.lit(total) + claims > TOTAL_CAP, "over budget").otherwise("ok")
    )
    return both.select("pr", "sha", "author", "claims", verdict.alias("verdict"))
