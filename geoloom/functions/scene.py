"""Numbers behind the picture of a spring: a seeded generator of 32-bit numbers, the sun's height, words for light and weather."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
#: The start and factor of the hash, the step of the generator.
HASH_START, HASH_FACTOR, STEP = 0x811C9DC5, 0x01000193, 0x6D2B79F5
#: Least heights of the sun with their words; most weather codes with theirs; steam by °C.
LIGHT = ((25, "high sun"), (6, "low sun"), (-4, "golden hour"), (-6, "blue hour"), (-12, "dusk"))
WEATHER = ((0, "clear sky"), (3, "partly cloudy"), (48, "fog"), (67, "drizzle"), (77, "snow"), (82, "rain showers"), (99, "thunderstorms"))
STEAM = ((25, 6), (38, 14), (50, 22))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def times_32(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two unsigned 32-bit numbers, kept as longs; no step overflows a long."""
    high, low = F.shiftright(a, 16), a.bitwiseAND(F.lit(0xFFFF))
    return _low(low * b + F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16))


def hash_seed(text: Column) -> Column:
    """A text's 32-bit seed: a fold over its UTF-16 units; null stays null."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), F.length(digits).cast("int") - 4, F.lit(4))).otherwise(F.array().cast("array<int>"))
    units = F.transform(places, lambda i: F.conv(digits.substr(i + 1, F.lit(4)), 16, 10).cast("long"))
    return F.when(text.isNotNull(), F.aggregate(units, F.lit(HASH_START).cast("long"), lambda h, u: times_32(h.bitwiseXOR(u), F.lit(HASH_FACTOR).cast("long"))))


def random_at(seed: Column, n: int = 1) -> Column:
    """The ``n``-th number (from 1) in [0, 1) of a 32-bit seed's sequence."""
    a = _low(seed.cast("long") + F.lit(STEP * n & _MASK))
    t = times_32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = _low(t + times_32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(2.0**32)


def _second(at: Column) -> tuple[Column, Column]:
    """(day of the year, second of the day) in UTC, whatever the session's zone."""
    seconds = F.unix_timestamp(at)
    return F.dayofyear(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))), F.pmod(seconds, F.lit(86_400))


def solar_elevation(lat: Column, lng: Column, at: Column) -> Column:
    """Degrees of the sun above the horizon at a moment, by the usual approximation."""
    day, second = _second(at)
    tilt = F.radians(-23.44 * F.cos(2 * math.pi * (day + 10) / 365))
    angle = F.radians(15 * (second / 3600 + lng / 15 - 12))
    height = F.sin(F.radians(lat)) * F.sin(tilt) + F.cos(F.radians(lat)) * F.cos(tilt) * F.cos(angle)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), height))))


def day_progress(lng: Column, at: Column) -> Column:
    """The share of the local solar day that is over, to the minute."""
    hours = F.floor(_second(at)[1] / 60) / 60
    return F.pmod(hours + lng / 15, F.lit(24.0)) / 24


def _ladder(x: Column, steps: tuple, rest, test) -> Column:
    out = None
    for bound, said in steps:
        out = F.when(test(x, bound), F.lit(said)) if out is None else out.when(test(x, bound), F.lit(said))
    return out.otherwise(F.lit(rest))


def daylight_word(elevation: Column) -> Column:
    return _ladder(elevation, LIGHT, "night", lambda x, b: x > b)


def weather_label(code: Column) -> Column:
    return _ladder(code, WEATHER, "changing skies", lambda x, b: x <= b)


def steam_count(celsius: Column) -> Column:
    """How much steam a temperature gives; an unknown one gives none."""
    return F.when(celsius.isNull(), 0).otherwise(_ladder(celsius, STEAM, 30, lambda x, b: x < b))


def picked(springs: DataFrame, seed: int, least: int = 50) -> DataFrame:
    """One row of ``springs`` (id, celsius, completeness), each with the same chance: of those with a temperature and
    a completeness of ``least``, if there are any.

    Every row draws a number from its id and the seed, and the smallest wins: one pass, no sort.
    """
    draw = random_at(hash_seed(F.col("id").cast("string")).bitwiseXOR(F.lit(seed).cast("long")))
    poor = F.coalesce(~(F.col("celsius").isNotNull() & (F.col("completeness") >= least)), F.lit(True))
    return springs.agg(F.min_by(F.struct(*springs.columns), F.struct(poor, draw, "id")).alias("s")).where("s is not null").select("s.*")
