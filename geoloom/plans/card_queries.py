"""Registered queries of cards, searches over tags and towns, rules by kind, excerpts and addresses, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import card, parse
from ..operators import claims, fills, rules
from .queries import SPRINGS, query
from .search import Filters, search
from .tables import springs, table


def _fixed(x: str, digits: int) -> str:
    """Exact halves go up, as in ``card.fixed``."""
    return f"printf('%.{digits}f', {x} + CASE WHEN ({x}) * {2 ** (digits + 1)} % 2 = 1 THEN 1e-6 ELSE 0 END)"


def _round(x: str) -> str:
    return f"floor({x} + 0.5)::BIGINT"


_PLAIN = r"regexp_replace(({x})::DOUBLE::VARCHAR, '\.0$', '')"
_CARDS = f"""{SPRINGS}, c AS (
  SELECT id, lat, lng, celsius, floor((celsius * 9 / 5 + 32) * 10 + 0.5) / 10 AS f, hours, policy,
    CASE WHEN id % 4 <> 0 THEN (id * 7) % 3000 END AS height, ((id * 37) % 20000)::DOUBLE AS m, CASE WHEN id % 3 <> 0 THEN ((id * 11) % 5000)::DOUBLE END AS vague FROM springs)"""


@query(f"""{_CARDS} SELECT id, coalesce({_PLAIN.format(x="celsius")} || '°C', 'Unknown') AS temp_c, coalesce({_PLAIN.format(x="f")} || '°F', 'Unknown') AS temp_f,
CASE WHEN celsius IS NULL THEN NULL WHEN celsius < 30 THEN '<86°F' WHEN celsius < 38 THEN '86°F–100°F' WHEN celsius < 43 THEN '100°F–109°F' WHEN celsius < 50 THEN '109°F–122°F' ELSE '122°F+' END AS band_f,
{_fixed("abs(lat)", 4)} || CASE WHEN lat >= 0 THEN '°N, ' ELSE '°S, ' END || {_fixed("abs(lng)", 4)} || CASE WHEN lng >= 0 THEN '°E' ELSE '°W' END AS place,
coalesce(height || ' m', 'Unknown') AS height_m, coalesce({_round("height * 3.28084::DOUBLE")} || ' ft', 'Unknown') AS height_ft,
CASE WHEN m < 1000 THEN ({_round("m / 5")} * 5) || ' m' ELSE {_fixed("m / 1000", 1)} || ' km' END AS near_c,
CASE WHEN m * 3.28084::DOUBLE < 5280 THEN ({_round("m * 3.28084::DOUBLE / 10")} * 10) || ' ft' ELSE {_fixed("m * 3.28084::DOUBLE / 5280", 1)} || ' mi' END AS near_f,
CASE WHEN m / 1000 < 10 THEN {_fixed("m / 1000", 1)} ELSE {_round("m / 1000")}::VARCHAR END || ' km' AS far_c,
'located to about ' || CASE WHEN vague >= 1000 THEN {_PLAIN.format(x="floor(vague / 100 + 0.5) / 10")} || ' km' ELSE {_round("vague")} || ' m' END AS vague_c,
CASE hours WHEN 'open' THEN 'Open' ELSE 'Unknown' END AS hours, CASE policy WHEN 'optional' THEN 'Clothing optional' WHEN 'required' THEN 'Nudity required' ELSE 'Unknown' END AS clothing,
id % 8 = 0 AS prohibited, CASE WHEN id % 8 = 0 THEN 'Bathing is not permitted here. ' || CASE WHEN id % 3 = 0 THEN 'The site is closed to visitors.' ELSE 'The managing agency restricts it.' END ELSE '' END AS notice FROM c""")
def card_texts(spark, sf_dir):
    k = F.col("id")
    celsius = F.col("celsius")
    height = F.when(k % 4 != 0, (k * 7) % 3000)
    metres = ((k * 37) % 20000).cast("double")
    vague = F.when(k % 3 != 0, ((k * 11) % 5000).cast("double"))
    band = F.when(celsius.isNotNull(), parse.temp_band(celsius))
    notice = card.prohibition(F.when(k % 8 == 0, False).when(k % 8 == 1, True), F.when(k % 3 == 0, "closed").otherwise("unknown"))
    none = F.lit(None).cast("double")
    return springs(spark, sf_dir).select(
        "id", card.temperature(celsius, none, "c").alias("temp_c"), card.temperature(celsius, none, "f").alias("temp_f"), card.band_range(band, "f").alias("band_f"),
        card.coordinates(F.col("lat"), F.col("lng")).alias("place"), card.elevation(height, "c").alias("height_m"), card.elevation(height, "f").alias("height_ft"),
        card.short_distance(metres, "c").alias("near_c"), card.short_distance(metres, "f").alias("near_f"), card.distance(metres / 1000, "c").alias("far_c"),
        card.accuracy(vague, "c").alias("vague_c"), card.label(F.col("hours"), card.HOURS).alias("hours"), card.label(F.col("policy"), card.CLOTHING).alias("clothing"),
        notice["prohibited"].alias("prohibited"), notice["text"].alias("notice"),
    )


@query(rf"""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN (p_size % 14) / 2.0::DOUBLE END AS ph, CASE WHEN p_partkey % 3 = 0 THEN p_size * 10 END AS sulfate, CASE WHEN p_partkey % 5 = 0 THEN p_size / 4.0::DOUBLE END AS iron,
  CASE p_partkey % 4 WHEN 0 THEN 'mg/l' WHEN 1 THEN 'mg/kg' END AS unit, CASE WHEN p_partkey % 6 = 0 THEN '1998' END AS year FROM part),
u AS (SELECT *, CASE unit WHEN 'mg/l' THEN ' mg/L' WHEN 'mg/kg' THEN ' mg/kg' ELSE '' END AS tail FROM p)
SELECT id, concat_ws('; ', 'pH ' || {_PLAIN.format(x="ph")}, 'Sulfate ' || sulfate || tail, 'Iron ' || {_PLAIN.format(x="iron")} || tail) AS panel,
  concat_ws(' ', CASE WHEN year IS NULL THEN '{card.UNDATED}' ELSE 'Analysed 1998 according to the source below.' END, CASE WHEN unit IS NULL AND coalesce(sulfate, iron) IS NOT NULL THEN '{card.NO_UNIT}' END, '{card.NOT_TESTED}') AS footnote FROM u""")
def mineral_panel(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    figures = {"ph": F.when(k % 2 == 0, (size % 14) / 2.0), "sulfate": F.when(k % 3 == 0, size * 10), "iron": F.when(k % 5 == 0, size / 4.0)}
    unit = F.when(k % 4 == 0, "mg/l").when(k % 4 == 1, "mg/kg")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), unit.alias("unit"), F.when(k % 6 == 0, "1998").alias("year"), card.mineral_rows(figures, unit).alias("rows"))
    panel = F.array_join(F.transform("rows", lambda r: F.concat_ws(" ", r["label"], r["value"])), "; ")
    return rows.select("id", panel.alias("panel"), card.minerals_footnote(F.col("rows"), F.col("unit"), F.col("year")).alias("footnote"))


@query(f"""{SPRINGS}, t AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'Town ' || (id % 40) ELSE '' END AS town, CASE id % 4 WHEN 0 THEN ['River', 'wild'] WHEN 1 THEN ['', 'view'] WHEN 2 THEN [] END AS tags FROM springs)
SELECT id, town, completeness FROM t WHERE contains(lower(concat_ws(' ', name, country, region, nullif(town, ''), nullif(array_to_string(list_filter(tags, lambda x: x <> ''), ' '), ''))), 'town 12 river') ORDER BY completeness DESC, id LIMIT 60""")
def search_tags_towns(spark, sf_dir):
    k = F.col("id")
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    tags = F.when(k % 4 == 0, strings("River", "wild")).when(k % 4 == 1, strings("", "view")).when(k % 4 == 2, strings())
    rows = springs(spark, sf_dir).withColumns({"nearest_town": F.when(k % 3 == 0, F.concat(F.lit("Town "), (k % 40).cast("string"))).otherwise(""), "tags": tags})
    return search(rows, Filters(query=" TOWN 12 River ")).select("id", F.col("nearest_town").alias("town"), "completeness")


@query(f"""{SPRINGS} SELECT id, CASE WHEN country = 'C3' AND id % 2 = 0 AND id <> 128 THEN 'bare' WHEN country = 'C4' AND id IN (4, 129, 5) THEN 'named' WHEN country IN ('C3') AND regexp_matches(coalesce(name, ''), 'Spring 3$') THEN 'pattern' END AS rule
FROM springs WHERE rule IS NOT NULL""")
def rules_by_kind(spark, sf_dir):
    listed = spark.createDataFrame(
        [("bare", 1, "C3", "attribute-free", None, None, [128]), ("named", 2, "C4", "listed", None, [4, 129, 5], None), ("pattern", 3, "C3", "name-pattern", "Spring 3$", None, None)],
        "rule string, ord int, country string, kind string, pattern string, ids array<long>, except array<long>",
    ).withColumns({c: F.lit(None).cast("double") for c in ("west", "south", "east", "north")})
    rows = springs(spark, sf_dir).withColumns({"id": F.col("id").cast("long"), "attribute_free": F.col("id") % 2 == 0}).drop("kind")
    return rules.first_rule(rows, listed).where("rule is not null").select("id", "rule")


@query("""SELECT id, celsius, CASE WHEN described THEN 'hot' ELSE said END AS qualitative, CASE WHEN described THEN '1981' END AS measured_at, CASE WHEN described THEN 'described' WHEN words IS NOT NULL AND held THEN 'deferred' END AS outcome FROM (
SELECT *, words IS NOT NULL AND said IS NULL AND NOT held AS described FROM (
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 50)::DOUBLE END AS celsius, CASE WHEN o_orderkey % 3 = 0 THEN 'warm' END AS said, o_orderkey % 7 = 0 AS held, CASE WHEN p_size % 2 = 0 THEN 'hot' END AS words
FROM orders LEFT JOIN part ON p_partkey = o_orderkey))""")
def described_fill(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    records = orders.select(k.alias("id"), F.when(k % 5 != 0, (k % 50).cast("double")).alias("celsius"), none.alias("measured_at"), F.when(k % 3 == 0, "warm").otherwise(F.when(k % 2 == 0, "")).alias("qualitative"))
    readings = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(None).cast("double").alias("reading"), F.when(F.col("p_size") % 2 == 0, "hot").otherwise("").alias("words"), F.lit("1981").alias("read_at"))
    held = fills.held_fields(orders.select(k.alias("id"), F.lit("celsius").alias("field"), F.lit("50").alias("value"), F.when(k % 7 != 0, "retracted").alias("state")))
    return fills.fill_temperature(records, readings, held).select("id", "celsius", "qualitative", "measured_at", "outcome")


_FIELDS = ("access.price", "hours.open", "description", "location.nearestTown", "name", "minerals.types")
_FIELD_CASES = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FIELDS))
_FIELD_ROWS = ", ".join(f"('{f}', {i}, '{w}')" for f in _FIELDS for i, w in enumerate(claims.FIELD_WORDS[f]))


@query(f"""WITH k(field, ord, kw) AS (VALUES {_FIELD_ROWS}),
d AS (SELECT row_number() OVER () AS r, id, text, lower(text) AS low, CASE id % {len(_FIELDS)} {_FIELD_CASES} END AS field
  FROM (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1000000000 + page_id, coalesce(html, '') FROM pages)),
s AS (SELECT r, ord, kw, length(text) AS size, string_split(low, kw) AS parts FROM d JOIN k ON k.field = d.field),
p AS (SELECT r, ord, kw, size, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM s),
h AS (SELECT *, sum(length(part)) OVER (PARTITION BY r, ord ORDER BY i) + (i - 1) * length(kw) AS pos FROM p),
w AS (SELECT r, ord, kw, size, pos, greatest(0, least(pos - 150, size - 300)) AS start FROM h WHERE i < n),
c AS (SELECT a.r, a.ord, a.kw, a.pos, a.start, count(*) AS score FROM w a JOIN w b ON a.r = b.r AND b.pos >= a.start AND b.pos < a.start + 300 WHERE a.size > 300 GROUP BY ALL),
b AS (SELECT r, arg_min(kw, (-score, ord, pos)) AS kw, arg_min(start, (-score, ord, pos)) AS start, max(score) AS score FROM c GROUP BY r),
f AS (SELECT r, arg_min(kw, ord) AS kw FROM w WHERE size <= 300 GROUP BY r)
SELECT id, coalesce(b.start, 0)::INT AS "at", coalesce(b.kw, f.kw) AS matched, coalesce(b.score, 0)::INT AS score, md5(CASE WHEN length(text) <= 300 THEN text ELSE substr(text, coalesce(b.start, 0)::BIGINT + 1, 300) END) AS excerpt
FROM d LEFT JOIN b USING (r) LEFT JOIN f USING (r)""")
def field_excerpts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select((1_000_000_000 + F.col("page_id")).alias("id"), F.col("html").alias("text"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(pages)
    field = F.get(F.array(*map(F.lit, _FIELDS)), (F.col("id") % len(_FIELDS)).cast("int"))
    found = texts.select("id", claims.field_excerpt(F.col("text"), field, 300).alias("e"))
    return found.select("id", "e.at", "e.matched", "e.score", F.md5(F.col("e.text").cast("binary")).alias("excerpt"))


@query(r"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'spring' WHEN 1 THEN 'page' ELSE 'map' END AS kind, CASE event_id % 6 WHEN 0 THEN 'whs_' || substr(md5(event_id::VARCHAR), 1, 12) END AS id,
CASE event_id % 6 WHEN 1 THEN 'safety' END AS page FROM events""")
def routes(spark, sf_dir):
    k = F.col("event_id")
    ident = F.concat(F.lit("whs_"), F.substring(F.md5(k.cast("string").cast("binary")), 1, 12))
    path = (
        F.when(k % 6 == 0, F.concat(F.lit("/atlas//s/"), ident, F.lit("/"))).when(k % 6 == 1, "/atlas/safety").when(k % 6 == 2, F.concat(F.lit("/s/"), F.upper(ident)))
        .when(k % 6 == 3, F.concat(F.lit("/s/"), ident, F.lit("0"))).when(k % 6 == 4, F.concat(F.lit("/atlas/about/"), ident)).otherwise("")
    )
    return table(spark, sf_dir, "events").select("event_id", parse.route(path, "/atlas/").alias("r")).select("event_id", "r.kind", "r.id", "r.page")
