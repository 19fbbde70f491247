"""Free-text attributes to typed fields, as columns.  What is not said stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import half_up

#: Words for a temperature nobody measured, strongest first.
QUALITATIVE = ("scalding", "very hot", "hot", "warm", "tepid", "cool", "cold")
#: Upper bounds (exclusive) of the temperature bands, °C.
BANDS = (("cool", 30.0), ("warm", 38.0), ("hot", 43.0), ("very hot", 50.0))
#: Plausible °C.
LEAST_C, MOST_C = -5.0, 130.0
#: Fields that count towards completeness, in order.
FIRST_CLASS = ("name", "temperature", "price", "clothing", "hours", "type")


def fahrenheit(celsius: Column) -> Column:
    return half_up(celsius * 9 / 5 + 32, 1)


def parse_temperature(raw: Column) -> Column:
    """struct<celsius, is_range, qualitative>.

    A range keeps its upper bound; °F is converted; values outside the
    plausible window are refused.
    """
    text = F.trim(raw)
    low = F.lower(text)
    in_f = low.rlike(r"(^|[^a-z])f($|[^a-z])|fahrenheit") & ~F.contains(low, F.lit("celsius"))
    spaced = F.regexp_replace(low, r"^(.*?\d)\s*(?:-|–|—|to|\.\.)\s*(\d.*)$", "$1~$2")
    is_range = spaced != low
    found = F.transform(F.regexp_extract_all(spaced, F.lit(r"-?\d+(?:[.,]\d+)?"), F.lit(0)), lambda n: F.try_to_number(F.replace(n, F.lit(","), F.lit(".")), F.lit("S9999999999D9999999999")).cast("double"))
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    value = F.when(is_range & second.isNotNull(), F.greatest(first, second)).otherwise(first)
    celsius = F.when(in_f, (value - 32) * 5 / 9).otherwise(value)
    word = F.coalesce(*[F.when(low.rlike(rf"(?<![a-z0-9_]){q}(?![a-z0-9_])"), F.lit(q)) for q in QUALITATIVE])
    fit = celsius.between(LEAST_C, MOST_C)
    return F.struct(F.when(fit, half_up(celsius, 1)).alias("celsius"), F.coalesce(is_range & fit, F.lit(False)).alias("is_range"), word.alias("qualitative"))


def temp_band(celsius: Column) -> Column:
    out = F.when(celsius.isNull() | F.isnan(celsius), "unknown")
    for name, most in BANDS:
        out = out.when(celsius < most, name)
    return out.otherwise("scalding")


def known_fields(name: Column, celsius: Column, price: Column, policy: Column, hours: Column, kind: Column) -> Column:
    """The first-class fields that are known, in order."""
    said = lambda c: c.isNotNull() & (c != "")
    tests = (said(name), celsius.isNotNull(), said(price), policy != "unknown", hours != "unknown", kind != "unknown")
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(f)) for t, f in zip(tests, FIRST_CLASS, strict=True)]))


def completeness(known: Column) -> Column:
    return half_up(100.0 * F.size(known) / len(FIRST_CLASS)).cast("int")


def parse_access(tags: Column) -> Column:
    """struct<price, currency> from a tag map: an amount, a fee, a donation."""
    charge = F.coalesce(F.nullif(tags["charge"], F.lit("")), F.nullif(tags["fee:amount"], F.lit("")))
    fee = F.lower(tags["fee"])
    price = F.when(charge.isNotNull(), F.trim(charge)).when(fee == "no", "Free").when(fee == "yes", "Paid (amount unknown)").when((fee == "donation") | F.contains(tags["payment"], F.lit("donation")), "Donation")
    currency = F.nullif(F.regexp_extract(charge, r"(?<![A-Za-z0-9_])([A-Z]{3})(?![A-Za-z0-9_])", 1), F.lit(""))
    return F.struct(price.alias("price"), currency.alias("currency"))


def attribute_free(tags: Column) -> Column:
    """Only ``natural`` and ``name...`` keys."""
    return F.forall(F.map_keys(tags), lambda k: (k == "natural") | k.startswith("name"))


def mint_id(ref: Column) -> Column:
    """A durable id from a source reference."""
    return F.concat(F.lit("whs_"), F.substring(F.sha2(ref, 256), 1, 12))


def sound_url(url: Column) -> Column:
    """An https URL without credentials whose host is a dotted name, no address and not reserved."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    reserved = host.rlike(r"(^|\.)(localhost|local|internal|test|example|invalid)$")
    address = host.rlike(r"^[0-9.]+$") | F.contains(host, F.lit(":"))
    plain = url.startswith("https://") & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    return F.coalesce(plain & F.contains(host, F.lit(".")) & ~reserved & ~address, F.lit(False))


#: Pages beside the map, and the form of a durable id.
PAGES = ("about", "terms", "privacy", "safety")
ID_PATTERN = r"^whs_[0-9a-f]{12}\z"


def route(path: Column, base: str = "") -> Column:
    """struct<kind, id, page> of an address path below ``base``: a spring, a page, or the map for all else."""
    base = base.rstrip("/")
    inner = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path) if base else path
    parts = F.filter(F.split(inner, "/"), lambda x: x != "")
    first, second, n = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.size(parts)
    ident = F.when((n == 2) & (first == "s") & second.rlike(ID_PATTERN), second)
    page = F.when((n == 1) & first.isin(*PAGES), first)
    kind = F.when(ident.isNotNull(), "spring").when(page.isNotNull(), "page").otherwise("map")
    return F.struct(kind.alias("kind"), ident.alias("id"), page.alias("page"))


def private_ipv4(address: Column) -> Column:
    """Loopback, private, link-local, shared or unspecified IPv4."""
    part = F.transform(F.split(address, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    return a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))


def private_address(address: Column) -> Column:
    """Whether an IPv4 or IPv6 address is none of the public ones; what is no address at all counts as private.

    IPv4 in its IPv6 form is judged as what it is.
    """
    low = F.lower(F.trim(address))
    inner = F.regexp_extract(low, r"^::(?:ffff:)?([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    v4 = F.when(inner != "", inner).otherwise(low)
    octets = F.transform(F.split(v4, r"\."), lambda x: F.when(x.rlike("^[0-9]{1,3}$"), x.cast("int")))
    is_v4 = (F.size(octets) == 4) & F.forall(octets, lambda x: F.coalesce(x <= 255, F.lit(False)))
    groups = F.split(low, ":")
    short = F.size(F.split(low, "::")) == 2
    is_v6 = low.rlike("^[0-9a-f:]+$") & F.forall(groups, lambda x: F.length(x) <= 4) & F.when(short, F.size(groups) <= 9).otherwise((F.size(groups) == 8) & ~F.exists(groups, lambda x: x == "")) & (F.size(F.split(low, "::")) <= 2)
    own_v6 = low.isin("::", "::1") | low.startswith("fe80") | low.rlike("^f[cd]")
    return F.coalesce(F.when(is_v4, private_ipv4(v4) | (F.get(octets, F.lit(0)) >= 224)).when(is_v6, own_v6), F.lit(True))
