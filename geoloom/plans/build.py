"""The whole build: upstream tables in, all published tables out, together or not at all.

Stages share their intermediate tables, which are written to the session's
shared folder.  Nothing is collected but checks that must stop the build.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import display, parse, tags
from ..functions.geo import half_up
from ..functions.parse import completeness, fahrenheit, known_fields
from ..functions.text import identity_name, norm_name
from ..operators import admission, catalogue, cluster, dedupe, fields, registry, rules, spatial, summary
from ..shared import written

#: Texts that records carry.
MAP_TEMPERATURE = "OpenStreetMap `temperature` tag"
CATALOGUE_SOURCE = "NOAA NCEI, Thermal Springs List for the United States (1981), doi:10.25921/c8p0-zs06"
CATALOGUE_PAGE = "https://doi.org/10.25921/c8p0-zs06"
CATALOGUE_WARNING = "Recorded in a 1981 federal compilation and not been checked on the ground since. The temperature, and the existence of this spring, are historical."
#: Metres within which a pin is bound by its name, and the least letters of such a name.
BIND_M, LEAST_NAME = 1500, 3
MANIFEST = "CURRENT"


@dataclass
class Inputs:
    """What a build reads.

    elements: type, id, lat, lng, tags (map); edges: country outlines as in ``spatial.country_of`` with ``name``; bad_rules: as in
    ``rules.first_rule``; catalogue: lines (value); boxes: land managers as in ``rules.restrict``; overlays: claims as in ``fields``;
    exclusions: as in ``rules.without_private``; registry: as in ``registry.advance``; history: events so far (spring, type, to, ts).
    """

    elements: DataFrame
    edges: DataFrame
    bad_rules: DataFrame
    catalogue: DataFrame
    boxes: DataFrame
    overlays: DataFrame
    exclusions: DataFrame
    registry: DataFrame
    history: DataFrame
    today: str


def _known(r: dict[str, Column]) -> Column:
    return known_fields(r["name"], r["temperature"]["celsius"], r["access"]["price"], r["clothing"]["policy"], r["hours"]["status"], r["type"])


def normalised(elements: DataFrame, today: str) -> DataFrame:
    """Map elements (key, type, id, lat, lng, tags, country, country_name) as full records with ``refs`` and ``element``; rejected ones should be left out before."""
    t, day = F.col("tags"), F.lit(today)
    said = lambda *names: F.coalesce(*[F.nullif(t[n], F.lit("")) for n in names])
    text, number = (lambda n: F.lit(None).cast("string").alias(n)), (lambda n: F.lit(None).cast("double").alias(n))
    ref = F.concat("type", F.lit("/"), F.col("id").cast("string"))
    read = elements.withColumns({"_t": parse.parse_temperature(t["temperature"]), "_a": parse.parse_access(t), "_c": tags.parse_clothing(t), "_h": tags.parse_hours(t), "_kind": tags.parse_kind(t)})
    celsius, word = F.col("_t.celsius"), F.col("_t.qualitative")
    source = F.when(celsius.isNotNull(), MAP_TEMPERATURE).when(word.isNotNull(), F.concat(F.lit('OpenStreetMap describes this spring as "'), word, F.lit('". No measurement recorded.')))
    known = known_fields(said("name", "name:en", "name:en-Latn"), celsius, F.col("_a.price"), F.col("_c.policy"), F.col("_h.status"), F.col("_kind"))
    own = said("access")
    status = F.when(own.isin("yes", "permissive", "public"), "public").when(own == "permit", "permit").otherwise("unknown")
    return read.select(
        "key", F.concat(F.lit("osm-"), F.replace(ref, F.lit("/"), F.lit("-"))).alias("id"), F.array(F.concat(F.lit("osm:"), ref)).alias("refs"), F.col("type").alias("element"), said("name", "name:en", "name:en-Latn").alias("name"),
        F.struct(
            half_up(F.col("lat"), 6).alias("lat"), half_up(F.col("lng"), 6).alias("lng"), display.elevation(t["ele"]).cast("double").alias("elevation"), "country", F.col("country_name").alias("countryName"),
            said("addr:state", "addr:province", "is_in:state").alias("region"), said("addr:city", "addr:town", "is_in:city").alias("nearestTown"), F.lit(None).cast("int").alias("accuracyMeters"),
        ).alias("location"),
        F.struct(celsius.alias("celsius"), fahrenheit(celsius).alias("fahrenheit"), source.alias("source"), text("measuredAt"), word.alias("qualitative"), F.lit("unknown").alias("kind")).alias("temperature"),
        F.struct("_a.price", "_a.currency", text("notes"), status.alias("status"), F.lit(None).cast("boolean").alias("bathingAllowed")).alias("access"), F.col("_c").alias("clothing"),
        F.struct("_h.open", F.col("_h.seasonal_notes").alias("seasonalNotes"), "_h.status").alias("hours"),
        F.struct(number("ph"), *[number(x) for x in fields.UNITED], F.array().cast("array<string>").alias("types"), text("notes"), text("measuredAt"), text("unit")).alias("minerals"),
        F.col("_kind").alias("type"), F.lit(False).alias("unicorn"), F.lit(False).alias("verified"), day.alias("lastVerified"), F.array_distinct(display.source_urls(F.col("type"), F.col("id"), t)).alias("sources"),
        said("description", "description:en").alias("description"), tags.derive_tags(t, celsius).alias("tags"), tags.derive_warnings(t, celsius, F.col("_kind")).alias("warnings"),
        F.struct(F.array(F.lit("osm")).alias("provenance"), completeness(known).alias("completeness"), known.alias("known"), F.lit(False).alias("curated"), day.alias("ingestedAt")).alias("quality"),
    )


#: Values that a merged record takes from the first of its records that has one.
FILLED = ("name", "description", "temperature.qualitative", "access.price", "access.currency", "access.notes", "hours.open", "hours.seasonalNotes", "location.elevation", "location.region", "location.nearestTown")
UNITED = ("sources", "warnings", "tags", "refs", "quality.provenance")


def merge_records(records: DataFrame) -> DataFrame:
    """Records (with ``key`` and ``survivor``, a key) as one each: the survivor's, with the gaps filled from the others in order.

    Lists are united (tags and provenance sorted), a temperature or clothing rule is taken whole where the survivor has
    none, unknown types and statuses are replaced, and the score is counted anew.  A value that the survivor has is never replaced.
    """
    order = F.struct((F.col("key") != F.col("survivor")).cast("int"), "key")
    first = lambda value, test: F.min_by(value, F.when(F.coalesce(test, F.lit(False)), order))
    known = {path: first(fields.get_path(path), fields.get_path(path).isNotNull()) for path in FILLED}
    whole = {
        "temperature": first(F.col("temperature"), F.col("temperature.celsius").isNotNull()), "clothing": first(F.col("clothing"), F.col("clothing.policy") != "unknown"),
        "hours.status": first(F.col("hours.status"), F.col("hours.status") != "unknown"), "type": first(F.col("type"), F.col("type") != "unknown"),
    }
    names = {path: f"_v{i}" for i, path in enumerate([*known, *whole])}
    taken = records.groupBy("survivor").agg(*[v.alias(names[p]) for p, v in (known | whole).items()])
    lists = None
    for i, path in enumerate(UNITED):
        # an item stands where it came first
        items = records.select("survivor", order.alias("o"), F.posexplode(fields.get_path(path)).alias("at", "item")).groupBy("survivor", "item").agg(F.min(F.struct("o", "at")).alias("o"))
        one = items.groupBy("survivor").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "item"))), lambda x: x["item"]).alias(f"_l{i}"))
        lists = one if lists is None else lists.join(one, "survivor", "full_outer")
    kept = records.where("key = survivor").join(taken, "survivor").join(lists, "survivor", "left")
    values = {"temperature": F.col(names["temperature"]), "clothing": F.col(names["clothing"])}
    done = fields.with_paths(kept, values)
    values = {p: F.col(n) for p, n in names.items() if p not in ("temperature", "clothing")}
    for i, path in enumerate(UNITED):
        values[path] = F.array_sort(f"_l{i}") if path in ("tags", "quality.provenance") else F.col(f"_l{i}")
    return rescored(fields.with_paths(done, values).select(*records.columns)).drop("survivor")


def rescored(records: DataFrame) -> DataFrame:
    """``records`` with completeness and known fields as they are now."""
    known = _known({c: F.col(c) for c in ("name", "temperature", "access", "clothing", "hours", "type")})
    return records.withColumn("quality", F.col("quality").withField("completeness", completeness(known)).withField("known", known))


def coarse_bindings(records: DataFrame) -> DataFrame:
    """(pin, pin_refs, target, metres): catalogue pins (keys) beside the one record that bears their name, where that is no other pin's too."""
    named = records.select("key", "refs", "location.lat", "location.lng", identity_name(F.col("name")).alias("called"), admission.coarse_pin(F.col("quality.provenance")).alias("pin")).where(F.length("called") >= LEAST_NAME)
    pins = named.where("pin").select(F.col("key").alias("pin"), F.col("refs").alias("pin_refs"), "lat", "lng", "called")
    others = named.where("not pin").select(F.col("key").alias("target"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), F.col("called").alias("r_called"))
    pairs = spatial.radius_join(pins, others, BIND_M, spread="left").where("called = r_called")
    return spatial.unique_both_ways(pairs, "pin", "target").where("verdict = 'matched'").select("pin", "pin_refs", "target", "metres")


def build(spark: SparkSession, inputs: Inputs) -> dict[str, DataFrame]:
    """All outputs: records, suspects, candidates (catalogue rows with reasons), match_report, registry, events, contests, sites, restricted, suppressed, conflicts, summary (JSON), rejects."""
    today = inputs.today
    # elements: rejects, countries, quarantine
    raw = inputs.elements.withColumn("reason", admission.element_reject(F.col("tags"), F.col("lat"), F.col("lng")))
    raw = written(raw.withColumn("key", F.monotonically_increasing_id()), "elements")
    fit = raw.where("reason is null").drop("reason")
    countries = spatial.country_of(fit.select("key", "lat", "lng"), inputs.edges, "key").withColumnRenamed("poly", "country")
    named = inputs.edges.groupBy(F.col("poly").alias("country")).agg(F.first("name").alias("country_name"))
    placed = fit.join(countries, "key").join(named, "country", "left").withColumn("country_name", F.coalesce("country_name", F.lit("Unknown")))
    borehole = admission.suspected_borehole(F.col("tags"))
    listed = rules.first_rule(placed.select(F.col("key").alias("id"), "country", "lat", "lng", F.coalesce(F.col("tags")["name"], F.lit("")).alias("name"), parse.attribute_free(F.col("tags")).alias("attribute_free")), inputs.bad_rules).select(F.col("id").alias("key"), "rule")
    judged = written(placed.withColumn("_hole", borehole).join(listed, "key", "left").withColumn("reason", F.coalesce("_hole", F.concat(F.lit("rule "), "rule"))).drop("_hole", "rule"), "judged")
    suspects = judged.where("reason is not null").select("type", "id", "country", "lat", "lng", "reason")
    records = normalised(judged.where("reason is null"), today)

    # catalogue rows
    lines = admission.read_catalogue(inputs.catalogue).withColumn("id", F.monotonically_increasing_id())
    lines = written(lines, "catalogue")
    sound = lines.where("reason is null").drop("reason")
    admitted = written(admission.admit(sound, inputs.boxes), "admitted")
    base = F.lit(1 << 50)
    minted = catalogue.to_records(admitted.where("reason is null"), F.lit(today), CATALOGUE_SOURCE, CATALOGUE_PAGE, CATALOGUE_WARNING)
    minted = minted.withColumn("element", F.lit(None).cast("string")).withColumn("key", F.monotonically_increasing_id() + base)
    pool = written(records.unionByName(minted), "pool")

    # duplicates, then durable ids
    spots = pool.select(F.col("key").alias("id"), F.col("key").alias("ord"), "location.lat", "location.lng", norm_name(F.col("name")).alias("norm"), F.col("element").alias("kind"), "quality.completeness")
    folded = dedupe.survivors(spots).withColumnRenamed("id", "key")
    merged = written(merge_records(pool.join(folded, "key")), "merged")
    bound = written(coarse_bindings(merged), "bindings")
    unique = merged.join(bound.select(F.col("pin").alias("key")), "key", "left_anti")
    asked = unique.select("key", "refs", "location.lat", "location.lng", "name", F.col("element").alias("kind"))
    prior = inputs.registry.withColumn("kind", F.nullif(F.regexp_extract(F.array_join(F.filter("refs", lambda r: r.startswith("osm:")), " "), "^osm:([a-z]+)/", 1), F.lit("")))
    resolved = registry.resolve(asked, prior)
    identified = written(unique.join(resolved.select("key", "spring", "how"), "key"), "identified")
    bound = bound.join(identified.select(F.col("key").alias("target"), "spring"), "target").select("pin_refs", "metres", F.col("spring").alias("into"))
    pins = bound.select(F.explode("pin_refs").alias("ref"), "into", "metres").where(F.col("ref").startswith(f"{catalogue.PROVIDER}:"))
    state, identity_events = registry.advance(inputs.registry, identified.select("key", "spring", "refs", "location.lat", "location.lng", "name"), today, pins.select("ref", "into"))
    # records of one spring that did not fold stay the first one's
    first = F.row_number().over(W.partitionBy("spring").orderBy("key"))
    owned = identified.withColumn("_n", first).where("_n = 1").withColumn("id", F.col("spring")).drop("_n", "spring", "how")

    # the catalogue's temperatures, unless an author claimed one
    plain = owned.where(~admission.coarse_pin(F.col("quality.provenance")))
    rows = sound.where("celsius is not null or qualitative is not null").select(F.col("id").alias("row"), "name", "lat", "lng", "celsius", "qualitative", "state")
    ref = F.concat(F.lit(f"{catalogue.PROVIDER}:"), admission.ref_key(F.col("state"), F.col("lat"), F.col("lng")))
    bindings = pins.groupBy("ref").agg(F.min_by(F.struct("into", "metres"), "into").alias("_b"))
    became = owned.where(admission.coarse_pin(F.col("quality.provenance"))).select(F.explode("refs").alias("_pin")).distinct()
    report = catalogue.match(rows, plain.select("id", "name", "location.lat", "location.lng")).join(rows.select("row", "celsius", "qualitative", ref.alias("ref")), "row")
    # a row whose pin was bound by its name is that record's, also from further away; one that became a record needs none
    told = report.join(bindings, "ref", "left").join(became, F.col("ref") == F.col("_pin"), "left")
    tied = (F.col("outcome") == "unmatched") & F.col("_b").isNotNull()
    outcome = F.when(tied, "matched").when((F.col("outcome") == "unmatched") & F.col("_pin").isNotNull(), "became a record").otherwise(F.col("outcome"))
    told = told.select("row", F.when(tied, F.col("_b.into")).otherwise(F.col("id")).alias("id"), F.when(tied, F.col("_b.metres")).otherwise(F.col("metres")).alias("metres"), outcome.alias("outcome"), "reason", "celsius", "qualitative")
    # two rows may be bound to one record: both are refused, as rows that contend are
    wanted = F.count(F.when(F.col("outcome") == "matched", 1)).over(W.partitionBy("id"))
    crowded = (F.col("outcome") == "matched") & (wanted > 1)
    report = written(told.withColumns({"outcome": F.when(crowded, "rejected").otherwise(F.col("outcome")), "reason": F.when(crowded, catalogue.CONTENDED).otherwise(F.col("reason"))}), "report")
    claimed = inputs.overlays.where((F.col("field") == "temperature.celsius") & (F.coalesce("state", F.lit("active")) != "retracted")).select("id").distinct().withColumn("_held", F.lit(True))
    found = report.where("outcome = 'matched'").select("id", F.col("celsius").alias("_c"), F.col("qualitative").alias("_q"))
    beside = owned.join(found, "id", "left").join(claimed, "id", "left").withColumn("_open", F.col("_held").isNull())
    gap = F.col("_open") & F.col("_c").isNotNull() & F.col("temperature.celsius").isNull()
    word = F.when(F.col("_open") & F.col("temperature.qualitative").isNull(), F.col("_q"))
    conflicts = beside.where(F.col("_open") & (F.col("temperature.celsius") != F.col("_c"))).select("id", F.col("temperature.celsius").alias("atlas"), F.col("_c").alias("catalogue"))
    touched = gap | word.isNotNull()
    values = {
        "temperature.celsius": F.when(gap, F.col("_c")), "temperature.fahrenheit": F.when(gap, fahrenheit(F.col("_c"))), "temperature.source": F.when(gap, CATALOGUE_SOURCE), "temperature.measuredAt": F.when(gap, catalogue.MEASURED),
        "temperature.kind": F.when(gap, "source"), "temperature.qualitative": word, "sources": F.when(touched, F.array_union("sources", F.array(F.lit(CATALOGUE_PAGE)))),
        "quality.provenance": F.when(touched, F.array_sort(F.array_union("quality.provenance", F.array(F.lit(catalogue.PROVIDER))))), "warnings": F.when(gap, tags.reconciled_warnings(F.col("warnings"), F.col("_c"))),
    }
    filled = written(rescored(fields.with_paths(beside, values)).select(*owned.columns), "filled")

    # reviewed claims; a wrong one stops the build
    wrong = fields.errors(inputs.overlays).first()
    if wrong:
        raise ValueError(f"overlay {wrong['id']}: {wrong['error']}")
    overlays = inputs.overlays.select("id").distinct()
    orphans = overlays.join(state.select(F.col("spring").alias("id")), "id", "left_anti").first()
    if orphans:
        raise ValueError(f"overlay {orphans['id']} belongs to no spring")
    contests = fields.contests(filled, inputs.overlays)
    applied = written(fields.apply(filled, inputs.overlays), "applied")

    # land managers, then privacy
    held = rules.restrict(applied.select("id", "location.lat", "location.lng", "access.status", F.col("access.bathingAllowed").alias("bathing")), inputs.boxes)
    barred = held.select("id", F.col("status").alias("_status"), "bathing", F.col("warnings").alias("_warning"))
    bound = applied.join(barred, "id", "left")
    more = F.filter(F.split("_warning", "; "), lambda w: w != "")
    warned = F.when(F.col("_warning").isNotNull(), F.array_union("warnings", more))
    restricted = fields.with_paths(bound, {"access.status": F.col("_status"), "access.bathingAllowed": F.col("bathing"), "warnings": warned}).select(*applied.columns)
    public = rules.without_private(restricted.select("id", "name", "refs", "location.lat", "location.lng").withColumn("refs", F.transform("refs", lambda r: F.regexp_replace(r, "^osm:", ""))), inputs.exclusions).select("id")
    final = written(admission.refuse(restricted.join(public, "id"), ~F.col("unicorn"), "a record that must not be published"), "final")

    # places and counts
    points = final.select(F.col("key").alias("id"), F.col("id").alias("spring"), "location.lat", "location.lng")
    sites = written(cluster.sites(points).select(F.col("id").alias("key"), "spring", "site", "springs"), "sites")
    label = sites.groupBy("site").agg(F.min("spring").alias("label"))
    placed_sites = sites.join(label, "site").select("key", F.col("spring").alias("id"), F.col("label").alias("site"), "springs")
    counted = final.join(placed_sites.select("key", "site", "springs"), "key")
    flat = counted.select("location.country", F.col("location.countryName").alias("country_name"), "type", "site", "temperature.celsius", "access.price", F.col("hours.open").alias("hours_open"), "clothing.policy")
    claims_told = contests.select(F.col("id").alias("spring"), F.lit("claim.contested").alias("type"), "to", F.lit(today).alias("ts"))
    fresh = identity_events.unionByName(claims_told)
    same = (F.col("h.spring") == F.col("n.spring")) & (F.col("h.type") == F.col("n.type")) & F.col("h.to").eqNullSafe(F.col("n.to"))
    events = inputs.history.select("spring", "type", "to", "ts").unionByName(fresh.distinct().alias("n").join(inputs.history.alias("h"), same, "left_anti"))
    return {
        "records": counted.drop("key", "element"), "suspects": suspects, "candidates": lines.where("reason is not null").select("line", "reason").unionByName(admitted.where("reason is not null").select("line", "reason")), "match_report": report,
        "registry": state, "events": events, "contests": contests, "sites": placed_sites.drop("key"), "restricted": held, "suppressed": overlays.join(final.select("id"), "id", "left_anti"), "conflicts": conflicts,
        "rejects": raw.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")), "summary": summary.document(summary.counts(flat)),
    }


def publish(outputs: dict[str, DataFrame], path: str) -> str:
    """Write all outputs to a new folder below ``path``, then the manifest that names it; returns the folder's name.

    Readers go by the manifest, so they see all outputs of a build or none: a job that fails, or an invariant
    that does, leaves the manifest as it was.
    """
    spark = next(iter(outputs.values())).sparkSession
    name = f"build-{uuid.uuid4().hex}"
    for label, rows in outputs.items():
        rows.write.parquet(f"{path}/{name}/{label}")
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("append").text(f"{path}/{MANIFEST}")
    return name


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """(output: path) of the latest build that was finished."""
    lines = spark.read.text(f"{path}/{MANIFEST}").select("value", "_metadata.file_modification_time")
    last = lines.orderBy(F.desc("file_modification_time"), F.desc("value")).first()["value"]
    return {label: f"{path}/{last}/{label}" for label in ("records", "suspects", "candidates", "match_report", "registry", "events", "contests", "sites", "restricted", "suppressed", "conflicts", "rejects", "summary")}


def detail(records: DataFrame, ident: str, aliases: DataFrame | None = None) -> DataFrame:
    """The record of an id; of a merged one, the record it was merged into (``aliases``: old, current)."""
    if aliases is None:
        return records.where(F.col("id") == ident)
    asked = records.sparkSession.createDataFrame([(ident,)], "want string")
    current = asked.join(aliases, asked["want"] == aliases["old"], "left").select(F.coalesce("current", "want").alias("id"))
    return records.join(F.broadcast(current), "id", "left_semi")
