"""Registered queries of claims on all fields, and of the ledger, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, ledger
from .queries import SPRINGS, query
from .tables import springs, table

_TYPES = "simple, chloride, bicarbonate, sulfate, carbon-dioxide, iron, acidic, iodine, sulfur, radioactive, aluminium"
_POLICIES = "optional, required, textile-only, mixed, unknown"
#: (field, value as JSON text, what is wrong with it or None), by kind; every spring makes one of these claims.
NUMBERS = (
    ("temperature.celsius", "42.5", None), ("temperature.celsius", "500", "temperature.celsius: must be a number between -5 and 130 C, got 500"), ("temperature.celsius", '"40"', 'temperature.celsius: must be a number between -5 and 130 C, got "40"'),
    ("temperature.fahrenheit", "108", None), ("temperature.fahrenheit", "300", "temperature.fahrenheit: must be a number between 23 and 266 F, got 300"), ("location.elevation", "1200", None),
    ("location.elevation", '"high"', 'location.elevation: value must be a number, got "high"'), ("minerals.ph", "7.2", None), ("minerals.iron", "null", "minerals.iron: value must be a number, got null"), ("minerals.tds", "1e3", None),
)
OPTIONS = (
    ("clothing.policy", '"mixed"', None), ("clothing.policy", '"nude"', f'clothing.policy: value must be one of {_POLICIES}, got "nude"'), ("hours.status", '"seasonal"', None),
    ("hours.status", '"OPEN"', 'hours.status: value must be one of open, seasonal, closed, unknown, got "OPEN"'), ("temperature.kind", '"bathing"', None), ("temperature.kind", "3", "temperature.kind: value must be one of source, bathing, unknown, got 3"),
    ("minerals.unit", '"mg/kg"', None), ("minerals.unit", '["mg/l"]', 'minerals.unit: value must be one of mg/l, mg/kg, got ["mg/l"]'),
)
TEXTS = (
    ("access.price", '"\\u00a55"', None), ("access.price", "5", "access.price: value must be a string, got 5"), ("minerals.notes", '"rare"', None), ("minerals.measuredAt", "2020", "minerals.measuredAt: value must be a string, got 2020"),
    ("description", '"calm"', None), ("type", '"onsen"', "type is not claimable"), ("location.lat", "1", "location.lat is not claimable"),
)
LISTS = (
    ("tags", '["quiet"]', None), ("tags", '"quiet"', "tags: value must be an array"), ("warnings", '["hot", 3]', "warnings: every element must be a string, but [1] is 3"), ("warnings", "[]", None),
    ("minerals.types", '["sulfur", "iron"]', None), ("minerals.types", "[]", f"minerals.types: value must be a non-empty array of {_TYPES}, got []"), ("minerals.types", '["gold"]', f'minerals.types: ["gold"] is not one of {_TYPES}'),
    ("minerals.types", '["iron", "iron"]', 'minerals.types: a value is repeated in ["iron","iron"]'), ("minerals.types", '["simple", "iron"]', 'minerals.types: "simple" is a classification only on its own; claim ["iron"]'),
)


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _cases_sql(cases: tuple) -> str:
    rows = ", ".join(f"({i}, {', '.join(map(_quoted, c))})" for i, c in enumerate(cases))
    return f"{SPRINGS}, cases(i, field, value, error) AS (VALUES {rows}) SELECT s.id AS spring, c.field, c.error FROM springs s JOIN cases c ON s.id % {len(cases)} = c.i WHERE c.error IS NOT NULL"


def _spring_id(k):
    return F.concat(F.lit("whs_"), F.lpad(F.lower(F.hex(k)), 12, "0"))


def _claims(spark, sf_dir, cases: tuple):
    """Each spring's case, from a good source."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v, _ in cases])
    rows = springs(spark, sf_dir).select(F.col("id").alias("spring"), F.get(values, (F.col("id") % len(cases)).cast("int")).alias("c"))
    return rows.select("spring", _spring_id(F.col("spring")).alias("id"), "c.*").withColumns({"source": F.lit("https://springs.museum/p"), "contributor": F.lit("ann"), "state": F.lit("active")})


def _faults(spark, sf_dir, cases: tuple):
    claims = _claims(spark, sf_dir, cases)
    return fields.errors(claims).select(F.conv(F.substring("id", 5, 12), 16, 10).cast("long").alias("spring"), "field", "error")


@query(_cases_sql(NUMBERS))
def claim_faults_numbers(spark, sf_dir):
    return _faults(spark, sf_dir, NUMBERS)


@query(_cases_sql(OPTIONS))
def claim_faults_options(spark, sf_dir):
    return _faults(spark, sf_dir, OPTIONS)


@query(_cases_sql(TEXTS))
def claim_faults_texts(spark, sf_dir):
    return _faults(spark, sf_dir, TEXTS)


@query(_cases_sql(LISTS))
def claim_faults_lists(spark, sf_dir):
    return _faults(spark, sf_dir, LISTS)


SOURCES = (
    ("https://springs.museum/p?q=1", None), (None, "source is required on every claim"), (" ", "source is required on every claim"), ("springs", 'source is not a URL: "springs"'), ("http://springs.museum", "source must be https, got http://"),
    ("https://a:b@springs.museum/", "source must not contain credentials"), ("https://10.0.0.1/x", "source must name a host, not an IP address"), ("https://[::1]:8/", "source must name a host, not an IP address"),
    ("https://intranet/", "source host is not publicly resolvable: intranet"), ("https://a.LOCAL/", "source host is not publicly resolvable: a.local"), ("https://x.home.arpa:443/", "source host is not publicly resolvable: x.home.arpa"),
)
_SOURCES_SQL = ", ".join(f"({i}, {_quoted(s)}, {_quoted(e)})" for i, (s, e) in enumerate(SOURCES))


@query(f"""{SPRINGS}, cases(i, source, error) AS (VALUES {_SOURCES_SQL}), s AS (SELECT id, id % {len(SOURCES)} AS i, id % 4 = 1 AS held, id % 5 = 2 AS anonymous, id % 6 = 3 AS missing, id % 7 = 4 AS two_units FROM springs)
SELECT id AS spring, CASE WHEN held THEN 'name is not claimable by an agent; it is reviewed by a person' ELSE 'description: ' || error END AS error FROM s JOIN cases USING (i) WHERE held OR error IS NOT NULL
UNION ALL SELECT id, 'description: contributor is required' FROM s WHERE anonymous AND NOT held
UNION ALL SELECT id, 'whs_' || lpad(lower(hex(id)), 12, '0') || ' is not a spring in this dataset' FROM s WHERE missing
UNION ALL SELECT id, 'temperature.celsius and temperature.fahrenheit: claim the unit the source printed, not both. The other is derived.' FROM s WHERE two_units""")
def claim_faults_agents(spark, sf_dir):
    """An agent's claims: sources, contributors, fields held back, unknown springs, and both units at once."""
    k = F.col("spring")
    rows = springs(spark, sf_dir).select(F.col("id").alias("spring"))
    sources = F.get(F.array(*[F.lit(s) for s, _ in SOURCES]), (k % len(SOURCES)).cast("int"))
    base = rows.select("spring", _spring_id(k).alias("id"), F.when(k % 4 == 1, "name").otherwise("description").alias("field"), F.lit('"x"').alias("value"), sources.alias("source"), F.when(k % 5 != 2, "bot").alias("contributor"), F.lit("active").alias("state"))
    good = {"source": F.lit("https://springs.museum"), "contributor": F.lit("bot")}
    units = [rows.where(k % 7 == 4).select("spring", _spring_id(k).alias("id"), F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit("active").alias("state")).withColumns(good) for f, v in (("temperature.celsius", "40"), ("temperature.fahrenheit", "104"))]
    # a retracted claim in the other unit is none
    retracted = rows.where(k % 7 == 5).select("spring", _spring_id(k).alias("id"), F.lit("temperature.celsius").alias("field"), F.lit("40").alias("value"), F.lit("retracted").alias("state")).withColumns(good)
    claims = base
    for more in (*units, retracted, retracted.withColumns({"field": F.lit("temperature.fahrenheit"), "value": F.lit("104"), "state": F.lit("active")})):
        claims = claims.unionByName(more)
    known = rows.where(k % 6 != 3).select(_spring_id(k).alias("id"))
    return fields.errors(claims, known, agent=True).select(F.conv(F.substring("id", 5, 12), 16, 10).cast("long").alias("spring"), "error")


def _nested(spark, sf_dir):
    """Springs as nested records; every third has no panel of minerals."""
    k = F.col("id")
    text = lambda: F.lit(None).cast("string")
    panel = F.struct(F.lit(7.0).alias("ph"), F.lit(None).cast("double").alias("iron"), F.array(F.lit("simple")).alias("types"), text().alias("unit"))
    return springs(spark, sf_dir).select(
        "id", "name", F.col("kind").alias("type"), F.struct("celsius", F.floor(F.col("celsius") * 9 / 5 + 32).cast("double").alias("fahrenheit"), F.lit("map").alias("source"), F.lit("2001").alias("measuredAt"), F.lit("unknown").alias("kind")).alias("temperature"),
        F.struct("price", text().alias("currency")).alias("access"), F.struct(F.col("policy")).alias("clothing"), F.struct(F.col("hours").alias("status")).alias("hours"), F.array(F.lit("clean"), F.col("kind")).alias("tags"),
        F.when(k % 3 != 0, panel).alias("minerals"), F.array(F.lit("https://map.museum")).alias("sources"), F.struct(F.lit(0).alias("completeness"), F.array().cast("array<string>").alias("known"), F.lit(False).alias("curated")).alias("quality"),
    )


APPLIED = (
    ("temperature.celsius", "41.26"), ("temperature.fahrenheit", "108"), ("access.price", '"7 EUR"'), ("clothing.policy", '"mixed"'), ("tags", '["quiet", "clean"]'), ("minerals.types", '["sulfur", "iron"]'),
    ("minerals.iron", "2.5"), ("minerals.unit", '"mg/l"'), ("name", '"Renamed"'), ("hours.status", '"closed"'), ("temperature.kind", '"source"'),
)


def _applied(spark, sf_dir):
    """Every second spring's case; some are superseded."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in APPLIED])
    k = F.col("id")
    rows = springs(spark, sf_dir).where(k % 2 == 1).select("id", F.get(values, (k % len(APPLIED)).cast("int")).alias("c"))
    state = F.when(k % 13 != 0, "active").otherwise("superseded")
    return rows.select("id", "c.*").withColumns({"source": F.lit("https://springs.museum"), "contributor": F.lit("ann"), "state": state, "measuredAt": F.when(k % 5 == 0, "2024-05-01")})


_CASE = f"c AS (SELECT *, CASE WHEN id % 2 = 1 AND id % 13 <> 0 THEN id % {len(APPLIED)} END AS i FROM springs)"


@query(f"""{SPRINGS}, {_CASE}, a AS (SELECT *, CASE i WHEN 0 THEN 41.26 WHEN 1 THEN 42.2 ELSE celsius END::DOUBLE AS c1, CASE i WHEN 0 THEN 106.3 WHEN 1 THEN 108 ELSE floor(celsius * 9 / 5 + 32) END::DOUBLE AS f1,
CASE i WHEN 2 THEN '7 EUR' ELSE price END AS price1, CASE i WHEN 3 THEN 'mixed' ELSE policy END AS policy1, CASE i WHEN 8 THEN 'Renamed' ELSE name END AS name1, CASE i WHEN 9 THEN 'closed' ELSE hours END AS hours1 FROM c)
SELECT id, c1 AS celsius, f1 AS fahrenheit, CASE WHEN i IN (0, 1) THEN 'Curated claim by ann: https://springs.museum' ELSE 'map' END AS t_source, CASE WHEN i IN (0, 1) THEN CASE WHEN id % 5 = 0 THEN '2024-05-01' END ELSE '2001' END AS measured,
CASE i WHEN 10 THEN 'source' ELSE 'unknown' END AS t_kind, price1 AS price, policy1 AS policy, hours1 AS hours, name1 AS name, CASE i WHEN 4 THEN 'clean,' || kind || ',quiet' ELSE 'clean,' || kind END AS tags,
CASE WHEN i = 5 THEN 'iron,sulfur' WHEN id % 3 <> 0 THEN 'simple' END AS types, CASE WHEN id % 3 <> 0 THEN 7.0::DOUBLE END AS ph, CASE i WHEN 6 THEN 2.5::DOUBLE END AS iron, CASE i WHEN 7 THEN 'mg/l' END AS unit,
CASE WHEN i IS NOT NULL THEN 2 ELSE 1 END AS n_sources, id % 2 = 1 AS curated, CASE WHEN id % 2 = 1 THEN floor(100.0::DOUBLE * ((name1 IS NOT NULL)::INT + (c1 IS NOT NULL)::INT + (coalesce(price1, '') <> '')::INT
  + (policy1 <> 'unknown')::INT + (hours1 <> 'unknown')::INT + (kind <> 'unknown')::INT) / 6 + 0.5)::INT ELSE 0 END AS completeness FROM a""")
def claims_applied(spark, sf_dir):
    done = fields.apply(_nested(spark, sf_dir), _applied(spark, sf_dir))
    t, m = F.col("temperature"), F.col("minerals")
    return done.select(
        "id", t["celsius"].alias("celsius"), t["fahrenheit"].alias("fahrenheit"), t["source"].alias("t_source"), t["measuredAt"].alias("measured"), t["kind"].alias("t_kind"), "access.price", "clothing.policy",
        F.col("hours.status").alias("hours"), "name", F.array_join("tags", ",").alias("tags"), F.array_join(m["types"], ",").alias("types"), m["ph"].alias("ph"), m["iron"].alias("iron"), m["unit"].alias("unit"), F.size("sources").alias("n_sources"),
        "quality.curated", "quality.completeness",
    )


@query(f"""{SPRINGS}, {_CASE} SELECT id, field, "from", "to" FROM (
SELECT id, 'temperature.celsius' AS field, celsius::VARCHAR AS "from", '41.26' AS "to" FROM c WHERE i = 0 AND abs(celsius - 41.26) > 0.5
UNION ALL SELECT id, 'temperature.fahrenheit', floor(celsius * 9 / 5 + 32)::VARCHAR, '108.0' FROM c WHERE i = 1 AND abs(floor(celsius * 9 / 5 + 32) - 108) > 0.9
UNION ALL SELECT id, 'access.price', '"' || price || '"', '"7 EUR"' FROM c WHERE i = 2 AND price <> '7 EUR'
UNION ALL SELECT id, 'clothing.policy', '"' || policy || '"', '"mixed"' FROM c WHERE i = 3
UNION ALL SELECT id, 'minerals.types', '["simple"]', '["iron","sulfur"]' FROM c WHERE i = 5 AND id % 3 <> 0
UNION ALL SELECT id, 'name', '"' || name || '"', '"Renamed"' FROM c WHERE i = 8 AND name IS NOT NULL
UNION ALL SELECT id, 'hours.status', '"' || hours || '"', '"closed"' FROM c WHERE i = 9
UNION ALL SELECT id, 'temperature.kind', '"unknown"', '"source"' FROM c WHERE i = 10)""")
def claims_contested(spark, sf_dir):
    return fields.contests(_nested(spark, sf_dir), _applied(spark, sf_dir))


@query("""WITH l AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'review/' || user_id || '/' || (event_id % 50) ELSE 'author/' || (user_id % 40) || '/' || user_id || '/' || event_id END AS key, ts AS day, (event_id % 4)::BIGINT AS claims FROM events),
d AS (SELECT date_trunc('day', max(ts)) AS since FROM events), r AS (SELECT c_custkey AS pr, (c_custkey % 60)::VARCHAR AS sha, (c_custkey % 45)::VARCHAR AS author, c_custkey % 31 AS claims FROM customer),
m AS (SELECT split_part(key, '/', 2) AS author, sum(claims) AS mine FROM l, d WHERE starts_with(key, 'author/') AND day >= since GROUP BY 1), t AS (SELECT coalesce(sum(claims), 0) AS total FROM l, d WHERE starts_with(key, 'review/') AND day >= since)
SELECT pr, sha, r.author, claims, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.key = 'review/' || pr || '/' || sha) THEN 'already reviewed' WHEN claims > 25 THEN 'too many claims (' || claims || ' > 25)'
WHEN coalesce(mine, 0) + claims > 30 THEN 'author cap' WHEN total + claims > 100 THEN 'over budget' ELSE 'ok' END AS verdict FROM r LEFT JOIN m ON m.author = r.author, t""")
def review_eligibility(spark, sf_dir):
    """Events as the ledger's entries, customers as requests; now is the end of the last day."""
    events = table(spark, sf_dir, "events")
    number, user = F.col("event_id"), F.col("user_id").cast("string")
    key = F.when(number % 2 == 0, F.concat_ws("/", F.lit("review"), user, (number % 50).cast("string"))).otherwise(F.concat_ws("/", F.lit("author"), (F.col("user_id") % 40).cast("string"), user, number.cast("string")))
    entries = events.select(key.alias("key"), F.col("ts").alias("at"), (number % 4).cast("long").alias("claims"))
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("pr"), (k % 60).cast("string").alias("sha"), (k % 45).cast("string").alias("author"), (k % 31).alias("claims"))
    now = events.agg(F.max("ts").alias("t")).first()["t"]
    return ledger.eligible(asked, entries, F.lit(now))
