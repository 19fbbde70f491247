"""Cells of measurement tables to values: sentinels, years, units, outlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that mean "no value".
NO_VALUE = (-99999.0, -9999.0, -999.0)
#: Milliseconds of the dates that mean "no date", 1900-01-01 and 1970-01-01.
NO_DATE = (-2208988800000.0, 0.0)
#: Metres within which a pin of the admitted catalogue lies.
CATALOGUE_ACCURACY_M = 500

_DAY_MS = 86_400_000
_MOST_MS = 8.64e15


def _cell(raw: Column) -> Column:
    text = F.trim(raw)
    return F.when((text != "") & (text != "N/A"), text)


def known_number(x: Column) -> Column:
    """Null for null, NaN, the infinities and the sentinels."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")) & ~x.isin(*NO_VALUE), x)


def year_of_millis(ms: Column) -> Column:
    """The UTC year, 1900 to 2100, as text; it doesn't depend on the session's zone."""
    days = F.floor(ms / _DAY_MS).cast("int")
    year = F.when((F.abs(ms) <= _MOST_MS) & known_number(ms).isNotNull() & ~ms.isin(*NO_DATE), F.year(F.date_add(F.lit("1970-01-01").cast("date"), days)))
    return F.when(year.between(1900, 2100), year.cast("string"))


def sampled_year(raw: Column) -> Column:
    """The first four digits, where they are a year from 1800 to 2100."""
    year = F.regexp_extract(_cell(raw), "[0-9]{4}", 0)
    return F.when(year.between("1800", "2100"), year)


def unit(raw: Column) -> Column:
    """mg/kg or mg/l; no other unit is guessed."""
    low = F.lower(_cell(raw))
    return F.when(low == "mg/kg", "mg/kg").when(low.isin("mg/l", "mg/ℓ"), "mg/l")


def accuracy_m(map_refs: Column, providers: Column, catalogue: str) -> Column:
    """Known only for pins that the catalogue alone has placed."""
    placed = F.coalesce(F.size(map_refs), F.lit(0)) > 0
    return F.when(~placed & F.array_contains(providers, catalogue), F.lit(CATALOGUE_ACCURACY_M))


def ring_centroid(wkt: Column) -> Column:
    """struct<lng, lat>: the area centroid of a polygon's outer ring.

    Without area it is the mean of the vertices; fewer than three points have
    none.
    """
    pairs = F.transform(F.split(F.regexp_extract(wkt, r"(?i)POLYGON\s*\(\((.+?)\)\)", 1), ","), lambda p: F.split(F.trim(p), r"\s+"))
    number = lambda pair, i: F.get(pair, F.lit(i)).try_cast("double")
    points = F.filter(
        F.transform(pairs, lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y"))),
        lambda p: known_finite(p["x"]) & known_finite(p["y"]),
    )
    sides = F.greatest(F.size(points) - 1, F.lit(0))
    start, end = F.slice(points, 1, sides), F.slice(points, 2, sides)

    def side(p: Column, q: Column) -> Column:
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct(cross.alias("a"), ((p["x"] + q["x"]) * cross).alias("x"), ((p["y"] + q["y"]) * cross).alias("y"), p["x"].alias("px"), p["y"].alias("py"))

    names = ("a", "x", "y", "px", "py")
    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])

    def middle(s: Column) -> Column:
        flat = s["a"] == 0
        area = F.nullif(s["a"], F.lit(0.0)) * 3
        return F.struct(F.when(flat, s["px"] / F.nullif(sides, F.lit(0))).otherwise(s["x"] / area).alias("lng"), F.when(flat, s["py"] / F.nullif(sides, F.lit(0))).otherwise(s["y"] / area).alias("lat"))

    found = F.aggregate(F.zip_with(start, end, side), zero, lambda s, e: F.struct(*[(s[n] + e[n]).alias(n) for n in names]), middle)
    return F.when(sides >= 2, found)


def known_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
