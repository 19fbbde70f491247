"""Tags of a mapped feature to typed fields, as columns.

``tags`` is a map<string,string>.  A missing key and an empty value both say
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the derived fields say.
SCALDING = "Scalding: recorded at 50°C or above. Water at this temperature causes burns in seconds."
VERY_HOT = "Very hot: above comfortable soaking temperature for most people. Enter slowly."
UNDEVELOPED = "Undeveloped source: no staff, no facilities, and no maintained access. Conditions change."
PERMISSIVE = "Access is permissive, not a right of way. The landowner can withdraw it at any time."
GEYSER = "Geyser: eruptive. Not for bathing."
NO_DRINKING = "Not drinking water."
TOLERATED = "Tolerated rather than formally permitted"
SEPARATED = "Gender-separated bathing recorded; check on site"
SCALDING_C, VERY_HOT_C = 50, 44

_MONTH = r"(?<![A-Za-z0-9_])(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)(?![A-Za-z0-9_])"


def _value(tags: Column, *keys: str) -> Column:
    """The first value that says something."""
    return F.coalesce(*[F.nullif(tags[k], F.lit("")) for k in keys])


def _said(tags: Column, *keys: str) -> Column:
    return _value(tags, *keys).isNotNull()


def _is(tags: Column, key: str, *values: str) -> Column:
    return F.coalesce(tags[key].isin(*values), F.lit(False))


def _matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def _texts(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def parse_clothing(tags: Column) -> Column:
    """struct<policy, schedule, notes>; a stated rule counts before separate areas."""
    nudism, optional, areas = F.lower(tags["nudism"]), F.lower(tags["clothing_optional"]), _value(tags, "bath:sex")
    policy = (
        F.when(nudism == "obligatory", "required").when(nudism.isin("customary", "yes", "permissive"), "optional").when(nudism == "no", "textile-only")
        .when(optional == "yes", "optional").when(optional == "no", "textile-only").when(areas == "separated", "mixed").otherwise("unknown")
    )
    schedule = F.when(areas.isNotNull(), F.concat(F.lit("Bathing areas: "), areas)).when(_said(tags, "female", "male"), SEPARATED)
    return F.struct(policy.alias("policy"), schedule.alias("schedule"), F.when(nudism == "permissive", TOLERATED).alias("notes"))


def parse_hours(tags: Column) -> Column:
    """struct<open, seasonal_notes, status>."""
    hours, season = _value(tags, "opening_hours"), _value(tags, "opening_hours:seasonal", "seasonal")
    gone = _is(tags, "disused", "yes") | _said(tags, "disused:natural", "disused:amenity")
    status = F.when(gone, "closed").when(_matches(hours, _MONTH), "seasonal").when(hours.isNotNull(), "open").when(season.isNotNull(), "seasonal").otherwise("unknown")
    return F.struct(hours.alias("open"), season.alias("seasonal_notes"), status.alias("status"))


def parse_kind(tags: Column) -> Column:
    """resort, developed, natural, wild or unknown."""
    bath = _is(tags, "amenity", "public_bath") | _said(tags, "bath:type")
    resort = _is(tags, "tourism", "hotel", "resort") | _is(tags, "leisure", "resort") | _matches(tags["name"], "(?i)resort|hotel|ryokan|spa")
    source = _is(tags, "natural", "hot_spring")
    built = _is(tags, "fee", "yes") | _said(tags, "operator", "building") | _is(tags, "leisure", "swimming_pool")
    known = _said(tags, "name", "website")
    return F.when(bath & resort, "resort").when(bath | (source & built), "developed").when(source & known, "natural").when(source, "wild").otherwise("unknown")


def derive_tags(tags: Column, celsius: Column) -> Column:
    """Labels in order, each once.  Sulfur may be named in any key or value."""
    bath = F.regexp_replace(F.lower(_value(tags, "bath:type")), "[^a-z]+", "-")
    return F.array_sort(F.array_distinct(_texts(
        F.when(_is(tags, "bath:open_air", "yes") | _is(tags, "outdoor", "yes"), "open-air"),
        F.when(_is(tags, "indoor", "yes") | _said(tags, "building"), "indoor"),
        F.when(_is(tags, "wheelchair", "yes"), "wheelchair-accessible"),
        F.when(_is(tags, "swimming", "yes") | _is(tags, "leisure", "swimming_pool"), "swimmable"),
        F.when(_matches(F.to_json(tags), "(?i)sulf|sulph|schwefel|硫"), "sulfur"),
        bath,
        F.when(_is(tags, "tourism", "camp_site") | _said(tags, "camp_site"), "camping-nearby"),
        F.when(celsius.between(38, 43), "soakable"),
        F.when(_is(tags, "drinking_water", "yes"), "drinking-water"),
        F.when(_said(tags, "wikidata", "wikipedia"), "well-documented"),
    )))


def temperature_warnings(celsius: Column) -> Column:
    number = ~F.isnan(celsius)
    return _texts(F.when(number & (celsius >= SCALDING_C), SCALDING).when(number & (celsius >= VERY_HOT_C), VERY_HOT))


def derive_warnings(tags: Column, celsius: Column, kind: Column) -> Column:
    hazard = _value(tags, "hazard", "hazard:type")
    others = _texts(
        F.when(kind == "wild", UNDEVELOPED),
        F.when(_is(tags, "access", "permissive"), PERMISSIVE),
        F.concat(F.lit("Mapped hazard: "), hazard, F.lit(".")),
        F.when(_matches(tags["natural"], "(?i)geyser"), GEYSER),
        F.when(_is(tags, "drinking_water", "no"), NO_DRINKING),
    )
    return F.concat(temperature_warnings(celsius), others)


def reconciled_warnings(warnings: Column, celsius: Column) -> Column:
    """``warnings`` with those about temperature as the final number has them, first."""
    others = F.filter(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: ~w.isin(SCALDING, VERY_HOT))
    return F.concat(temperature_warnings(celsius), others)
