"""Documents about a whole dataset: counts of everything in one pass, logs and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claims import strip_note

#: What may become of a proposal.
OUTCOMES = (
    "source-malformed", "source-not-found", "source-unreachable", "source-too-large", "value-absent-from-source", "different-subject", "refuted-by-verifier", "value-not-numeric",
    "value-wrong-shape", "verifier-verdict-malformed", "no-source-found", "no-claim-proposed", "overlay-rejected", "field-not-agent-claimable",
)
#: Verified springs a country should have.
TARGET_PER_COUNTRY = 2


def counts(records: DataFrame) -> DataFrame:
    """(section, key, n): every count of the summary, from one pass over ``records`` (country, country_name, type, site, celsius, price, hours_open, policy).

    Sections: total, sites, countries and coverage, by_type, by_country and sites_by_country (by name: of two
    countries of one name the smaller count of records stays; a site on a border counts in each).  All groupings are one
    GROUPING SETS; its rows, one a site and country at most, are counted once more.
    """
    said = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    known = {"temperature": F.count("celsius"), "price": F.count_if(said("price")), "hours": F.count_if(said("hours_open")), "clothing": F.count_if(F.col("policy") != "unknown")}
    c, name, kind, site = (F.col(x) for x in ("country", "country_name", "type", "site"))
    grouped = records.groupingSets([[], [c, name], [kind], [name, site], [site]], c, name, kind, site).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), *[v.alias(k) for k, v in known.items()])
    of = lambda *there: sum(8 >> i for i, x in enumerate(("country", "country_name", "type", "site")) if x not in there)
    sections = {of("country", "country_name"): "by_country", of("type"): "by_type", of("country_name", "site"): "sites_by_country", of("site"): "sites"}
    section = F.coalesce(*[F.when(F.col("g") == g, F.lit(s)) for g, s in sections.items()], F.lit("total"))
    key = F.when(section == "by_type", F.col("type")).when(section.isin("by_country", "sites_by_country"), F.col("country_name"))
    once = grouped.withColumn("section", section).withColumn("key", key)
    whole = F.when(F.col("section").isin("sites", "sites_by_country"), F.count("*")).otherwise(F.min("n"))
    totals = once.groupBy("section", "key").agg(whole.alias("n"), F.count("*").alias("rows"), *[F.max(k).alias(k) for k in known])
    more = F.array(F.struct(F.col("section").alias("section"), F.col("key").alias("key"), F.col("n").alias("n")), *[F.struct(F.lit("coverage").alias("section"), F.lit(k).alias("key"), F.col(k).alias("n")) for k in known])
    # one country a pair of code and name
    pairs = F.array(F.struct(F.col("section").alias("section"), F.col("key").alias("key"), F.col("n").alias("n")), F.struct(F.lit("countries").alias("section"), F.lit(None).cast("string").alias("key"), F.col("rows").alias("n")))
    own = F.array(F.struct(F.col("section").alias("section"), F.col("key").alias("key"), F.col("n").alias("n")))
    told = totals.select(F.explode(F.when(F.col("section") == "total", more).when(F.col("section") == "by_country", pairs).otherwise(own)).alias("e")).select("e.*")
    return told.groupBy("section", "key").agg(F.sum("n").alias("n"))


def document(counted: DataFrame, **others: Column) -> DataFrame:
    """(value): ``counts`` as one JSON document, countries by falling numbers; ``others`` are added as they are.

    It holds a few rows a country and type: small enough for one row.
    """
    entry = F.struct((-F.col("n")).alias("order"), F.coalesce("key", F.lit("")).alias("key"), "n")
    one = counted.groupBy().agg(*[F.array_sort(F.collect_list(F.when(F.col("section") == s, entry))).alias(s) for s in ("by_type", "by_country", "sites_by_country", "coverage")], *[F.max(F.when(F.col("section") == s, F.col("n"))).alias(f"_{s}") for s in ("total", "sites", "countries")])
    as_map = lambda c: F.map_from_entries(F.transform(c, lambda e: F.struct(e["key"], e["n"])))
    number = lambda s: F.coalesce(F.col(f"_{s}"), F.lit(0)).alias(s)
    return one.select(F.to_json(F.struct(number("total"), number("sites"), number("countries"), as_map("coverage").alias("coverage"), as_map("by_type").alias("byType"), as_map("by_country").alias("byCountry"), as_map("sites_by_country").alias("sitesByCountry"), *[v.alias(k) for k, v in others.items()])).alias("value"))


def event_counts(events: DataFrame) -> DataFrame:
    """(type, n): how many springs appeared, were merged, and so on."""
    return events.groupBy("type").agg(F.count("*").alias("n"))


def refutations(proposals: DataFrame, ts: Column) -> DataFrame:
    """The lines to append for proposals that failed (spring, field, proposed, source, proposer, verifier, stage, outcome, note).

    An outcome that is none of ``OUTCOMES`` fails the job, so nothing is written.
    """
    known = F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))
    told = F.when(known, F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit(f"outcome must be one of {', '.join(OUTCOMES)}; got "), F.coalesce("outcome", F.lit("null")))))
    return proposals.select(ts.alias("ts"), "spring", "field", "proposed", "source", "proposer", "verifier", "stage", told.alias("outcome"), strip_note(F.col("note")).alias("note"))


def plan_totals(plan: DataFrame) -> DataFrame:
    """One row (countries, candidates, met) of a plan: country, candidates (array), verified, already_had."""
    met = F.coalesce("verified", F.lit(0)) + F.coalesce("already_had", F.lit(0)) >= TARGET_PER_COUNTRY
    size = F.coalesce(F.size("candidates"), F.lit(0))
    return plan.agg(F.count("*").alias("countries"), F.coalesce(F.sum(F.when(size > 0, size).otherwise(0)), F.lit(0)).cast("long").alias("candidates"), F.count_if(met).alias("met"))
