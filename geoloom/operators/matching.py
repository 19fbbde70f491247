"""Measurement mirrors to springs: stations, named groups of wells, chemistry sites.

Contention is refused both ways, never settled.  Wells and springs at one spot
count as one place with its number of rows, so a place that holds a third of
all rows is one row of the distance join, and what a station says is kept as
its bounds and its latest reading, never as a list.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_up
from ..functions.text import norm_name
from .spatial import radius_join

#: A well above this temperature is no spring, °C; readings that agree lie within, °C; metres.
WELL_MOST_C, AGREE_C, NEAR_M = 100.0, 2.0, 200.0
#: Words that two sources of Japanese names write or leave out; the least length of a name held by another.
NAME_NOISE = ("温泉", "旅館", "ホテル", "荘", "の湯", "ノ湯")
LEAST_PART = 4


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def name_agreement(a: Column, b: Column) -> Column:
    """exact, substring or null: whether two names without the noise words are one place's."""
    x, y = (norm_name(F.regexp_replace(F.coalesce(n, F.lit("")), "|".join(NAME_NOISE), "")) for n in (a, b))
    long = F.least(F.length(x), F.length(y)) >= LEAST_PART
    return F.when((x == "") | (y == ""), None).when(x == y, "exact").when(long & (F.contains(x, y) | F.contains(y, x)), "substring")


def join_readings(stations: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` (station, value, unit, measured_at) in °C at their stations; other units and unknown stations drop out."""
    unit = F.lower(F.trim("unit"))
    celsius = F.when(unit.isin("c", "deg c"), F.col("value")).when(unit.isin("f", "deg f"), half_up((F.col("value") - 32) * 5 / 9, 1))
    read = results.withColumn("celsius", celsius).where(finite(F.col("celsius"))).select("station", "measured_at", "celsius")
    return read.join(stations, "station")


def group_stations(readings: DataFrame) -> DataFrame:
    """One row a station: name, lat, lng of its first reading, and what its readings say.

    ``readings``: station, ord, name, lat, lng, celsius, measured_at.  Rows without
    a station or with a number that is not finite say nothing, nor do wells
    above 100 °C.  ``celsius`` and ``measured_at`` are of the latest reading (the
    first of one date, undated ones last).
    """
    sound = readings.where((F.coalesce("station", F.lit("")) != "") & finite(F.col("lat")) & finite(F.col("lng")) & finite(F.col("celsius")) & (F.col("celsius") <= WELL_MOST_C))
    by_date = sound.groupBy("station", F.coalesce("measured_at", F.lit("")).alias("day")).agg(
        F.min_by(F.struct("celsius", "measured_at"), "ord").alias("reading"), F.min(F.struct("ord", "name", "lat", "lng")).alias("first"),
        F.count("*").alias("n"), F.min("celsius").alias("least"), F.max("celsius").alias("most"),
    )
    whole = by_date.groupBy("station").agg(F.max_by("reading", "day").alias("reading"), F.min("first").alias("first"), F.sum("n").alias("readings"), F.min("least").alias("least"), F.max("most").alias("most"))
    return whole.select("station", "first.name", "first.lat", "first.lng", "readings", "least", "most", "reading.celsius", "reading.measured_at")


def _lonely_pairs(springs: DataFrame, sites: DataFrame, radius_m: float) -> DataFrame:
    """(id, site, metres, near, springs): each spring with a site in reach.

    ``near`` is the number of its sites; ``site`` and ``springs``, the number of
    springs that have this site alone, are null where it is not one.
    """
    spots = sites.groupBy(F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng")).agg(F.count("*").alias("n"), F.min("site").alias("site"))
    places = springs.select("lat", "lng").distinct()
    reach = radius_join(places, spots, radius_m).groupBy("lat", "lng").agg(F.sum("n").alias("near"), F.min(F.struct("site", "metres")).alias("s"))
    only = F.when(F.col("near") == 1, F.col("s"))
    # springs of one spot are counted before they meet their station again
    sizes = springs.groupBy("lat", "lng").agg(F.count("*").alias("here"))
    claims = reach.withColumn("s", only).join(sizes, ["lat", "lng"]).where("s is not null").groupBy("s.site").agg(F.sum("here").alias("springs"))
    found = reach.select("lat", "lng", "near", only["site"].alias("site"), only["metres"].alias("metres"))
    return springs.join(found.join(claims, "site", "left"), ["lat", "lng"]).select("id", "site", "metres", "near", "springs")


def match_stations(springs: DataFrame, readings: DataFrame, radius_m: float = NEAR_M, agree_c: float = AGREE_C) -> DataFrame:
    """(id, station, metres, celsius, measured_at, readings, reason): a reading for springs without one.

    ``springs``: id, lat, lng, of those without a temperature.  A spring takes the
    latest reading of the one station in reach, if that station has no other
    such spring and its readings agree; otherwise ``reason`` says why nothing is
    taken.  Springs with no station in reach are left out.
    """
    stations = group_stations(readings)
    pairs = _lonely_pairs(springs, stations.withColumnRenamed("station", "site"), radius_m).withColumnRenamed("site", "station")
    joined = pairs.join(stations.select("station", "readings", "least", "most", "celsius", "measured_at"), "station", "left")
    span = F.col("most") - F.col("least")
    reason = (
        F.when(F.col("near") > 1, F.format_string(f"%d stations within {radius_m:g} m", "near"))
        .when(F.col("springs") > 1, F.format_string(f"station %s is within {radius_m:g} m of %d springs", "station", "springs"))
        .when(span > agree_c, F.format_string("station readings span %.1f C", half_up(span, 1)))
    )
    taken = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("station", "metres", "celsius", "measured_at", "readings")]
    return joined.withColumn("reason", reason).select("id", *taken, "reason")


def match_groups(wells: DataFrame, records: DataFrame, radius_m: float = NEAR_M) -> DataFrame:
    """(group, id, metres, agreement, reason): groups of wells under one name, each to one record.

    ``wells``: ser, onsen, source (names), lat, lng; ``records``: id, name, lat, lng,
    of the wells' country.  A group is what shares ``onsen``; a well without one
    stands alone.  A record in reach counts if its name agrees with either of
    the well's.  ``id`` is null where one group has several records.
    """
    key = F.coalesce("onsen", F.concat(F.lit("__ser:"), F.col("ser").cast("string")))
    spots = wells.groupBy(key.alias("group"), "onsen", "source", "lat", "lng").agg(F.min("ser").alias("ser"))
    places = records.groupBy("name", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng")).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    agreement = F.coalesce(name_agreement(F.col("name"), F.col("onsen")), name_agreement(F.col("name"), F.col("source")))
    pairs = radius_join(spots, places, radius_m, spread="left").withColumn("agreement", agreement).where("agreement is not null")
    nearest = pairs.groupBy("group", "id").agg(F.min(F.struct("metres", "ser", "agreement")).alias("best"), F.first("n").alias("n"))
    groups = nearest.groupBy("group").agg(F.sum("n").alias("hits"), F.min(F.struct("id", "best.metres", "best.agreement")).alias("hit"))
    one = F.when(F.col("hits") == 1, F.col("hit"))
    found = groups.select("group", one["id"].alias("id"), one["metres"].alias("metres"), one["agreement"].alias("agreement"))
    wanted = found.where("id is not null").groupBy("id").agg(F.count("*").alias("groups"))
    reason = F.when(F.col("id").isNull(), "one group, several springs").when(F.col("groups") > 1, "several groups, one spring")
    return found.join(wanted, "id", "left").select("group", "id", "metres", "agreement", reason.alias("reason"))


def group_sites(rows: DataFrame, tolerances: Mapping[str, float]) -> DataFrame:
    """One row a chemistry site, keyed by its position to five places.

    ``rows``: site, ord, name, lat, lng, measured_at and the fields.  ``v_<field>`` is
    the first value where all lie within the field's tolerance; ``withheld`` lists
    the fields whose values don't; ``measured_at`` is the latest.
    """
    sound = rows.where((F.coalesce("site", F.lit("")) != "") & finite(F.col("lat")) & finite(F.col("lng")))
    said = {f: F.when(finite(F.col(f)), F.col(f)) for f in tolerances}
    first = lambda x: F.min_by(x, F.when(x.isNotNull(), F.col("ord")))
    spans = [F.when(F.max(x) - F.min(x) <= tolerances[f], first(x)).alias(f"v_{f}") for f, x in said.items()]
    apart = F.array_compact(F.array(*[F.when(F.max(x) - F.min(x) > tolerances[f], F.lit(f)) for f, x in said.items()]))
    at = F.format_string("%.5f,%.5f", "lat", "lng")
    return sound.groupBy(at.alias("site")).agg(
        F.min_by("lat", "ord").alias("lat"), F.min_by("lng", "ord").alias("lng"), first(F.col("name")).alias("name"), F.max("measured_at").alias("measured_at"), *spans, apart.alias("withheld")
    )


def match_panels(springs: DataFrame, rows: DataFrame, tolerances: Mapping[str, float], radius_m: float = NEAR_M) -> DataFrame:
    """(id, site, metres, measured_at, v_<field>..., withheld, reason): a panel for springs with an empty one.

    The same contention as for stations; a site whose every field disagrees gives none.
    """
    sites = group_sites(rows, tolerances)
    values = [f"v_{f}" for f in tolerances]
    joined = _lonely_pairs(springs, sites, radius_m).join(sites.select("site", "measured_at", *values, "withheld"), "site", "left")
    reason = (
        F.when(F.col("near") > 1, F.format_string(f"%d chemistry sites within {radius_m:g} m", "near"))
        .when(F.col("springs") > 1, F.format_string(f"one site is within {radius_m:g} m of %d springs", "springs"))
        .when(F.coalesce(*values).isNull(), F.concat(F.lit("every field disagrees across analyses: "), F.array_join("withheld", ", ")))
    )
    taken = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("site", "metres", "measured_at", *values, "withheld")]
    return joined.withColumn("reason", reason).select("id", *taken, "reason")
