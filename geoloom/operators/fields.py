"""Claims on single fields of nested records, all driven by one table of fields.

A claim's value is JSON text, so a number, a text and a list are told apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import half_up
from ..functions.minerals import TYPES as MINERAL_TYPES
from ..functions.parse import completeness, known_fields


@dataclass(frozen=True)
class Field:
    """A claimable field: its kind (number, string, any, strings, types), what is allowed, its risk, and whether an agent may claim it."""

    kind: str
    risk: str
    agent: bool = True
    options: tuple[str, ...] = ()
    bounds: tuple[int, int, str] | None = None


#: The claimable fields with their kinds, permitted values, ranges and risks, in order.
FIELDS = {
    "name": Field("any", "elevated", agent=False),
    "temperature.celsius": Field("number", "high", bounds=(-5, 130, "C")),
    "temperature.fahrenheit": Field("number", "high", bounds=(23, 266, "F")),
    "temperature.kind": Field("option", "high", options=("source", "bathing", "unknown")),
    "access.price": Field("string", "low"),
    "access.currency": Field("any", "low"),
    "access.notes": Field("any", "elevated"),
    "clothing.policy": Field("option", "high", options=("optional", "required", "textile-only", "mixed", "unknown")),
    "clothing.schedule": Field("any", "high"),
    "clothing.notes": Field("any", "high"),
    "hours.open": Field("any", "low"),
    "hours.seasonalNotes": Field("any", "elevated"),
    "hours.status": Field("option", "elevated", options=("open", "seasonal", "closed", "unknown")),
    "description": Field("any", "low"),
    "tags": Field("strings", "low", agent=False),
    "warnings": Field("strings", "high", agent=False),
    "location.elevation": Field("number", "low"),
    "location.region": Field("any", "low"),
    "location.nearestTown": Field("any", "low", agent=False),
    "minerals.ph": Field("number", "high"),
    "minerals.tds": Field("number", "elevated"),
    "minerals.sulfate": Field("number", "elevated"),
    "minerals.bicarbonate": Field("number", "elevated"),
    "minerals.chloride": Field("number", "elevated"),
    "minerals.calcium": Field("number", "elevated"),
    "minerals.magnesium": Field("number", "elevated"),
    "minerals.sodium": Field("number", "elevated"),
    "minerals.potassium": Field("number", "elevated"),
    "minerals.silica": Field("number", "elevated"),
    "minerals.iron": Field("number", "elevated"),
    "minerals.types": Field("types", "high", options=MINERAL_TYPES),
    "minerals.notes": Field("string", "elevated"),
    "minerals.measuredAt": Field("string", "elevated"),
    "minerals.unit": Field("option", "elevated", options=("mg/l", "mg/kg")),
}
#: An id's form; how far a claim may lie from a known value without contesting it; names no public host has.
SPRING_ID = "^whs_[0-9a-f]{12}$"
TOLERANCE = {"temperature.celsius": 0.5, "temperature.fahrenheit": 0.9}
RESERVED_HOSTS = ("localhost", "local", "internal", "localdomain", "home.arpa")
TEMPERATURES = ("temperature.celsius", "temperature.fahrenheit")
#: Constituents that mean nothing without a unit.
UNITED = ("tds", "sulfate", "bicarbonate", "chloride", "calcium", "magnesium", "sodium", "potassium", "silica", "iron")


def _of_kind(*kinds: str) -> list[str]:
    return [name for name, f in FIELDS.items() if f.kind in kinds]


def risk(field: Column) -> Column:
    """low, elevated or high: the harm a wrong value does; null for fields nobody may claim."""
    return F.create_map(*[F.lit(x) for name, f in FIELDS.items() for x in (name, f.risk)])[field]


def _shown(value: Column) -> Column:
    """A value as JSON text."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$', "")


def source_fault(source: Column) -> Column:
    """Why a source is no public https URL, or null."""
    url = F.trim(source)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]{0,}([^/\\?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":[0-9]*$", ""))
    address = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | host.startswith("[")
    reserved = F.exists(F.array(*[F.lit(x) for x in RESERVED_HOSTS]), lambda x: (host == x) | host.endswith(F.concat(F.lit("."), x)))
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "source is required on every claim").when(scheme == "", F.concat(F.lit("source is not a URL: "), _shown(source)))
        .when(scheme != "https", F.concat(F.lit("source must be https, got "), scheme, F.lit("://"))).when(F.contains(authority, F.lit("@")), "source must not contain credentials")
        .when(host == "", "source has no hostname").when(address, "source must name a host, not an IP address")
        .when(~F.contains(host, F.lit(".")) | reserved, F.concat(F.lit("source host is not publicly resolvable: "), host))
    )


def _json_kind(value: Column) -> Column:
    """number, string, list, or other, of JSON text."""
    head = F.substring(F.trim(value), 1, 1)
    return F.when(head == '"', "string").when(head == "[", "list").when(F.trim(value).rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").otherwise("other")


def _text(value: Column) -> Column:
    """The text of a JSON string."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def _items(value: Column) -> Column:
    """The elements of a JSON list, as JSON texts."""
    return F.from_json(F.regexp_replace(value, r"^\s*$", "[]"), "array<variant>")


def _strings(value: Column) -> Column:
    return F.from_json(value, "array<string>")


def errors(claims: DataFrame, known: DataFrame | None = None, agent: bool = False) -> DataFrame:
    """(id, field, error): every reason for which a claim, or a record's claims together, must not be applied.

    ``claims``: id, field, value (JSON text), source, contributor, state (null: active); ``known``: ids that exist.
    Errors of a record as a whole have no field.  A field that is claimed twice is one of them.
    """
    value, field = F.col("value"), F.col("field")
    kind = _json_kind(value)
    shown = F.coalesce(value, F.lit("undefined"))
    number = F.when(kind == "number", value.try_cast("double"))
    sound = F.coalesce(F.abs(number) < float("inf"), F.lit(False))
    checks = []
    for name, f in FIELDS.items():
        mine, said = field == name, lambda *parts, name=name: F.concat(F.lit(f"{name}: "), *parts)
        if f.bounds:
            low, high, unit = f.bounds
            checks.append(F.when(mine & ~F.coalesce(sound & number.between(low, high), F.lit(False)), said(F.lit(f"must be a number between {low} and {high} {unit}, got "), shown)))
        elif f.kind == "option":
            fit = (kind == "string") & _text(value).isin(*f.options)
            checks.append(F.when(mine & ~F.coalesce(fit, F.lit(False)), said(F.lit(f"value must be one of {', '.join(f.options)}, got "), shown)))
        elif f.kind in ("number", "string"):
            fit = sound if f.kind == "number" else F.coalesce(kind == "string", F.lit(False))
            checks.append(F.when(mine & ~fit, said(F.lit(f"value must be a {f.kind}, got "), shown)))
        elif f.kind == "strings":
            items = F.when(kind == "list", _items(value))
            plain = F.transform(items, lambda x: F.schema_of_variant(x) == "STRING")
            bad = F.array_position(plain, False)
            checks.append(F.when(mine & items.isNull(), said(F.lit("value must be an array"))).when(mine & (bad > 0), said(F.lit("every element must be a string, but ["), (bad - 1).cast("string"), F.lit("] is "), F.to_json(F.get(items, (bad - 1).cast("int"))))))
        elif f.kind == "types":
            items = F.when(kind == "list", _strings(value))
            listed = ", ".join(f.options)
            unknown = F.filter(items, lambda x: ~F.coalesce(x.isin(*FIELDS["minerals.types"].options), F.lit(False)))
            canonical = canonical_types(items)
            checks.append(
                F.when(mine & (items.isNull() | (F.size(items) == 0)), said(F.lit(f"value must be a non-empty array of {listed}, got "), shown))
                .when(mine & (F.size(unknown) > 0), said(F.to_json(unknown), F.when(F.size(unknown) == 1, " is").otherwise(" are"), F.lit(f" not one of {listed}")))
                .when(mine & (F.size(F.array_distinct(items)) < F.size(items)), said(F.lit("a value is repeated in "), F.to_json(items)))
                .when(mine & (F.size(canonical) < F.size(items)), said(F.lit('"simple" is a classification only on its own; claim '), F.to_json(canonical)))
            )
    mine = lambda text: F.concat(field, F.lit(": "), text)
    common = [F.when(value.isNull(), mine(F.lit("value is required"))), F.when(source_fault(F.col("source")).isNotNull(), mine(source_fault(F.col("source")))), F.when(F.coalesce("contributor", F.lit("")) == "", mine(F.lit("contributor is required")))]
    held = [name for name, f in FIELDS.items() if not f.agent]
    no_agent = F.lit(agent) & field.isin(*held)
    found = (
        F.when(~F.coalesce(field.isin(*FIELDS), F.lit(False)), F.array(F.concat(field, F.lit(" is not claimable"))))
        .when(no_agent, F.array(F.concat(field, F.lit(" is not claimable by an agent; it is reviewed by a person")))).otherwise(F.array_compact(F.array(*common, *checks)))
    )
    each = claims.select("id", "field", F.explode(found).alias("error"))

    active = F.coalesce("state", F.lit("active")) == "active"
    units = F.collect_set(F.when(active & field.isin(*TEMPERATURES), field))
    per_id = claims.groupBy("id").agg(F.array_sort(units).alias("units"))
    twice = claims.groupBy("id", "field").count().where("count > 1").select("id", F.concat(field, F.lit(" is claimed twice")).alias("error"))
    malformed = ~F.coalesce(F.col("id").rlike(SPRING_ID), F.lit(False))
    whole = [
        per_id.where("size(units) > 1").select("id", F.concat(F.array_join("units", " and "), F.lit(": claim the unit the source printed, not both. The other is derived.")).alias("error")),
        per_id.where(malformed).select("id", F.concat(F.lit("id must look like whs_a1b2c3d4e5f6, got "), F.coalesce("id", F.lit("undefined"))).alias("error")), twice,
    ]
    if known is not None:
        whole.append(per_id.where(~malformed).join(known.select("id").distinct(), "id", "left_anti").select("id", F.concat(F.col("id"), F.lit(" is not a spring in this dataset")).alias("error")))
    for rows in whole:
        each = each.unionByName(rows.select("id", F.lit(None).cast("string").alias("field"), "error"))
    return each


def canonical_types(types: Column) -> Column:
    """Water types in their fixed order, each once, without "simple" beside another."""
    only = F.array_distinct(types)
    found = F.filter(F.array(*[F.lit(t) for t in MINERAL_TYPES]), lambda t: F.array_contains(only, t))
    return F.when(F.size(found) > 1, F.array_remove(found, "simple")).when(types.isNotNull(), found)


def get_path(path: str) -> Column:
    """The value at a dotted path; null below a null struct."""
    return F.col(".".join(f"`{part}`" for part in path.split(".")))


def with_paths(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``rows`` with the values at dotted paths set; a null struct on the way becomes one of nulls where any value below is set.

    Every path must exist in the schema; a value of null leaves its place as it is.
    """

    def build(kind: T.DataType, at: Column, inner: dict[str, Column]) -> Column:
        if "" in inner:
            # a list that can't hold nulls takes no cast
            return F.coalesce(inner[""] if isinstance(kind, T.ArrayType) else inner[""].cast(kind), at)
        names = {name.split(".")[0] for name in inner}
        if not isinstance(kind, T.StructType) or not names <= set(kind.names):
            raise ValueError(f"no such path: {sorted(inner)}")
        parts = []
        for f in kind.fields:
            own = {name.removeprefix(f.name).removeprefix("."): v for name, v in inner.items() if name.split(".")[0] == f.name}
            parts.append((build(f.dataType, at[f.name], own) if own else at[f.name]).alias(f.name))
        said = F.array_compact(F.array(*[v.isNotNull() for v in inner.values()]))
        return F.when(at.isNull() & ~F.array_contains(said, True), F.lit(None)).otherwise(F.struct(*parts))

    tops: dict[str, dict[str, Column]] = {}
    for path, value in values.items():
        top, _, rest = path.partition(".")
        tops.setdefault(top, {})[rest] = value
    return rows.withColumns({top: build(rows.schema[top].dataType, F.col(top), inner) for top, inner in tops.items()})


def _by_field(claims: DataFrame) -> DataFrame:
    """(id, claims): a map from field to claim, and ``sources`` of the active ones in the order of ``at``.  A record has at most one claim a field."""
    at = [F.col("at")] if "at" in claims.columns else [F.lit(0)]
    active = F.coalesce("state", F.lit("active")) == "active"
    own = claims.withColumn("_n", F.row_number().over(W.partitionBy("id", "field").orderBy(*at, "value"))).where("_n = 1")
    claim = F.struct("field", F.struct("value", "source", "contributor", F.col("measuredAt").alias("measured")).alias("c"))
    ordered = F.array_sort(F.collect_list(F.when(active, F.struct(*[a.alias("at") for a in at], "field", "source"))))
    return own.groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(active, claim))).alias("_claims"), F.transform(ordered, lambda x: x["source"]).alias("_sources"))


def _new_value(field: str, value: Column, kind: T.DataType) -> Column:
    """A claim's value as its field holds it."""
    f = FIELDS[field]
    if f.kind == "number":
        return value.try_cast("double").cast(kind)
    if f.kind == "strings":
        return _strings(value)
    if f.kind == "types":
        return canonical_types(_strings(value))
    return F.when(_json_kind(value) == "string", _text(value)).otherwise(value).cast(kind)


def _type_at(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def apply(records: DataFrame, claims: DataFrame) -> DataFrame:
    """``records`` with their active claims in place.

    ``records``: id, sources (array) and any of the nested fields of ``FIELDS``; claims on fields that the schema
    doesn't have are left out.  ``claims``: id, field, value (JSON text), source, contributor, state,
    measuredAt, and ``at`` (their order) if it matters for ``sources``; they should have no ``errors``.  Lists of texts are united
    and never shortened, other values replaced; the temperature in the other unit, its source and its date
    follow the claim; sources gain the claims'; ``quality`` (completeness, known, curated), where the schema has it,
    is computed anew for every record with claims.  Claims of other records change nothing.
    """
    schema = records.schema
    joined = records.join(_by_field(claims), "id", "left")
    claim = lambda field: F.col("_claims")[field]
    values: dict[str, Column] = {}
    for field, f in FIELDS.items():
        kind = _type_at(schema, field)
        if kind is None:
            continue
        value = _new_value(field, claim(field)["value"], kind)
        if f.kind == "strings":
            value = F.when(value.isNotNull(), F.array_union(F.coalesce(get_path(field), F.array().cast("array<string>")), value))
        values[field] = value
    c, f = (claim(t)["value"].try_cast("double") for t in TEMPERATURES)
    derived = {"temperature.fahrenheit": F.coalesce(f, half_up(c * 9 / 5 + 32, 1)), "temperature.celsius": F.coalesce(c, half_up((f - 32) * 5 / 9, 1))}
    taken = F.coalesce(*[claim(t) for t in TEMPERATURES])
    derived["temperature.source"] = F.concat(F.lit("Curated claim by "), taken["contributor"], F.lit(": "), taken["source"])
    values |= {path: value for path, value in derived.items() if _type_at(schema, path)}
    done = with_paths(joined, values)
    if _type_at(schema, "temperature.measuredAt"):
        # a claim without a date takes away the old one
        dated = F.when(taken.isNotNull(), taken["measured"]).otherwise(F.col("temperature.measuredAt"))
        done = done.withColumn("temperature", F.col("temperature").withField("measuredAt", dated))
    done = done.withColumn("sources", F.when(F.col("_sources").isNotNull(), F.array_union(F.coalesce("sources", F.array().cast("array<string>")), "_sources")).otherwise(F.col("sources")))
    if _type_at(schema, "quality.curated"):
        pick = lambda path: get_path(path) if _type_at(schema, path) else F.lit(None).cast("string")
        known = known_fields(pick("name"), F.col("temperature.celsius"), pick("access.price"), *[F.coalesce(pick(p), F.lit("unknown")) for p in ("clothing.policy", "hours.status", "type")])
        anew = {"completeness": completeness(known), "known": known, "curated": F.lit(True)}
        parts = [(anew[f.name].cast(f.dataType) if f.name in anew and f.name != "known" else anew.get(f.name, F.col("quality")[f.name])).alias(f.name) for f in schema["quality"].dataType.fields]
        done = done.withColumn("quality", F.when(F.col("_claims").isNotNull(), F.struct(*parts)).otherwise(F.col("quality")))
    return done.drop("_claims", "_sources")


def contests(records: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, field, from, to): active claims that disagree with a known value of the record, as JSON text.

    Numbers disagree beyond ``TOLERANCE`` (temperatures) or at all; water types as sets; lists of texts never, as
    they are united; nulls and empty lists are no values.
    """
    schema = records.schema
    cases = []
    for field, f in FIELDS.items():
        kind = _type_at(schema, field)
        if kind is None or f.kind == "strings":
            continue
        old, new = get_path(field), _new_value(field, F.col("value"), kind)
        if f.kind == "types":
            differs = (F.size(old) > 0) & ((F.size(F.array_except(old, new)) > 0) | (F.size(F.array_except(new, old)) > 0))
        elif field in TOLERANCE:
            differs = F.abs(old - new) > TOLERANCE[field]
        else:
            differs = old != new
        cases.append(F.when((F.col("field") == field) & F.coalesce(differs, F.lit(False)), F.struct(_shown(old).alias("from"), _shown(new).alias("to"))))
    active = claims.where(F.coalesce("state", F.lit("active")) == "active").select("id", "field", "value")
    return active.join(records, "id").select("id", "field", F.coalesce(*cases).alias("c")).where("c is not null").select("id", "field", "c.*")


def needs_unit(minerals: Column) -> Column:
    """Whether a panel has constituents and no unit."""
    figures = F.coalesce(*[minerals[x] for x in UNITED]).isNotNull()
    return F.coalesce(figures & (F.coalesce(minerals["unit"], F.lit("")) == ""), F.lit(False))
