"""What a record's card says, as columns: temperatures, places, water, notices.  ``units`` is "c" (metric) or "f"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .display import shortest
from .geo import half_up
from .parse import BANDS, fahrenheit

#: The texts of a card.
UNKNOWN = "Unknown"
UNNAMED = "Unnamed spring"
CLOTHING = {"optional": "Clothing optional", "required": "Nudity required", "textile-only": "Swimwear required", "mixed": "Mixed / varies", "unknown": UNKNOWN}
HOURS = {"open": "Open", "seasonal": "Seasonal", "closed": "Closed", "unknown": UNKNOWN}
TYPES = {"natural": "Natural", "developed": "Developed", "resort": "Resort", "wild": "Wild", "unknown": UNKNOWN}
ACCESS = {
    "public": "Open to the public.", "permit": "A permit is required to visit.", "view-only": "The site may be viewed but not entered.",
    "closed": "The site is closed to visitors.", "unknown": "The managing agency restricts it.",
}
UNITS = {"mg/l": "mg/L", "mg/kg": "mg/kg"}
CONSTITUENTS = {
    "sulfate": "Sulfate", "bicarbonate": "Bicarbonate", "chloride": "Chloride", "calcium": "Calcium", "magnesium": "Magnesium",
    "sodium": "Sodium", "potassium": "Potassium", "silica": "Silica", "iron": "Iron",
}
WATERS = {
    "simple": "Simple", "chloride": "Chloride", "bicarbonate": "Bicarbonate", "sulfate": "Sulfate", "carbon-dioxide": "Carbon dioxide", "iron": "Iron",
    "acidic": "Acidic", "iodine": "Iodine", "sulfur": "Sulfur", "radioactive": "Radioactive", "aluminium": "Aluminium",
}
DATED = ("Analysed ", " according to the source below.")
UNDATED = "The source publishes these figures without stating when the water was analysed."
NO_UNIT = "The source does not state what unit these figures are in."
NOT_TESTED = "Reported from public sources. This atlas does not test water and has not verified these figures on site."
NO_BATHING = "Bathing is not permitted here. "
FEET, MILE, MILES = 3.28084, 5280, 0.621371


def label(value: Column, labels: dict[str, str]) -> Column:
    """The text of a closed vocabulary's word; null for others."""
    out = F.lit(None).cast("string")
    for word, text in labels.items():
        out = F.when(value == word, text).otherwise(out)
    return out


def fixed(x: Column, digits: int) -> Column:
    """``x`` (not negative) with ``digits`` decimals, rounded by its exact binary value; halves go up."""
    # the only exact halves are odd multiples of 2^-(digits + 1)
    half = (x * float(2 ** (digits + 1))) % 2 == 1
    return F.call_function("format_number", x + F.when(half, 1e-6).otherwise(0.0), F.lit("0." + "0" * digits))


def _whole(x: Column) -> Column:
    return half_up(x).cast("long").cast("string")


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def temperature(celsius: Column, in_f: Column, units: str) -> Column:
    """The reading as the source has it; ``in_f`` null is converted, to a tenth."""
    said = _join(shortest(celsius), "°C") if units == "c" else _join(shortest(F.coalesce(in_f, fahrenheit(celsius))), "°F")
    return F.coalesce(said, F.lit(UNKNOWN))


def whole_degrees(celsius: Column, units: str, unit: bool = True) -> Column:
    """Whole degrees; with the unit an unknown reading is said to be unknown, without it is null."""
    number = _whole(celsius if units == "c" else celsius * 9 / 5 + 32)
    return F.coalesce(_join(number, "°", units.upper()), F.lit(UNKNOWN)) if unit else number


def band_range(band: Column, units: str, unit: bool = True) -> Column:
    """The range of a temperature band by its name; null for an unknown one."""
    names = [name for name, _ in BANDS] + ["scalding"]
    bounds = [whole_degrees(F.lit(most), units, unit) for _, most in BANDS]
    texts = [_join("<", bounds[0])] + [_join(a, "–", b) for a, b in zip(bounds, bounds[1:], strict=False)] + [_join(bounds[-1], "+")]
    out = F.lit(None).cast("string")
    for name, text in zip(names, texts, strict=True):
        out = F.when(band == name, text).otherwise(out)
    return out


def elevation(metres: Column, units: str) -> Column:
    return F.coalesce(_join(shortest(metres.cast("double")), " m") if units == "c" else _join(_whole(metres * FEET), " ft"), F.lit(UNKNOWN))


def coordinates(lat: Column, lng: Column) -> Column:
    side = lambda x, plus, minus: F.when(x >= 0, plus).otherwise(minus)
    return _join(fixed(F.abs(lat), 4), "°", side(lat, "N", "S"), ", ", fixed(F.abs(lng), 4), "°", side(lng, "E", "W"))


def short_distance(metres: Column, units: str) -> Column:
    """Inside one place: to 5 m or 10 ft, from 1 km or a mile on with a decimal."""
    if units == "f":
        feet = metres * FEET
        return F.when(feet < MILE, _join(_whole(half_up(feet / 10) * 10), " ft")).otherwise(_join(fixed(feet / MILE, 1), " mi"))
    return F.when(metres < 1000, _join(_whole(half_up(metres / 5) * 5), " m")).otherwise(_join(fixed(metres / 1000, 1), " km"))


def distance(km: Column, units: str) -> Column:
    """With a decimal below ten."""
    far, name = (km * MILES, " mi") if units == "f" else (km, " km")
    return _join(F.when(far < 10, fixed(far, 1)).otherwise(_whole(far)), name)


def accuracy(metres: Column, units: str) -> Column:
    """How precisely a pin is placed; null where nobody says."""
    known = metres.isNotNull() & ~F.isnan(metres) & (F.abs(metres) != float("inf"))
    if units == "c":
        far, small, large = metres >= 1000, _join(_whole(metres), " m"), _join(shortest(half_up(metres / 100) / 10), " km")
    else:
        feet = metres * FEET
        far, small, large = feet >= MILE, _join(_whole(half_up(feet / 10) * 10), " ft"), _join(shortest(half_up(feet / MILE * 10) / 10), " miles")
    return F.when(known, _join("located to about ", F.when(far, large).otherwise(small)))


def mineral_rows(figures: dict[str, Column], unit: Column) -> Column:
    """array<struct<key, label, value>> of the panel's known figures; pH first and without a unit.

    ``figures``: ph, tds and constituents by key; absent keys are not known.
    """
    said = label(unit, UNITS)
    suffix = F.coalesce(_join(" ", said), F.lit(""))
    lines = [("ph", "pH", F.lit("")), ("tds", "Dissolved solids", suffix), *[(k, text, suffix) for k, text in CONSTITUENTS.items()]]
    row = lambda k, text, end: F.when(figures[k].isNotNull(), F.struct(F.lit(k).alias("key"), F.lit(text).alias("label"), _join(shortest(figures[k].cast("double")), end).alias("value")))
    return F.array_compact(F.array(*[row(*line) for line in lines if line[0] in figures]))


def minerals_footnote(rows: Column, unit: Column, measured_at: Column) -> Column:
    """When the water was analysed, in what unit, and that nobody here did; ``rows`` as of ``mineral_rows``."""
    when = F.when(F.coalesce(measured_at, F.lit("")) != "", _join(DATED[0], measured_at, DATED[1])).otherwise(UNDATED)
    unsaid = F.when(label(unit, UNITS).isNull() & F.exists(rows, lambda r: r["key"] != "ph"), NO_UNIT)
    return F.concat_ws(" ", when, unsaid, F.lit(NOT_TESTED))


def has_minerals(rows: Column, types: Column, notes: Column) -> Column:
    """Whether anything of the water's chemistry is published."""
    return (F.size(rows) > 0) | (F.coalesce(F.size(types), F.lit(0)) > 0) | notes.isNotNull()


def temperature_display(celsius: Column, in_f: Column, qualitative: Column, measured_at: Column, kind: Column, source: Column, units: str) -> Column:
    """struct<primary, secondary, qualitative, measured_at, kind, source>; null parts are not shown."""
    known = celsius.isNotNull()
    said = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        temperature(celsius, in_f, units).alias("primary"),
        F.when(known, temperature(celsius, in_f, "f" if units == "c" else "c")).alias("secondary"),
        F.when(~known, _join("described as ", said(qualitative))).alias("qualitative"),
        _join("Measured ", said(measured_at), DATED[1]).alias("measured_at"),
        F.when(known & (kind != "unknown"), F.when(kind == "source", "at source").otherwise("bathing water")).alias("kind"),
        source.alias("source"),
    )


def prohibition(bathing_allowed: Column, status: Column) -> Column:
    """struct<prohibited, text>: only an explicit refusal forbids bathing."""
    refused = F.coalesce(~bathing_allowed, F.lit(False))
    return F.struct(refused.alias("prohibited"), F.when(refused, _join(NO_BATHING, label(status, ACCESS))).otherwise("").alias("text"))
