"""Durable ids: resolution against a registry, lifecycle, event log."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import cell, distance_m
from ..functions.parse import mint_id
from ..functions.text import norm_name
from ..shared import written
from .cluster import components
from .dedupe import SAME_NAME_M, same_spring
from .spatial import radius_join

#: What makes two events the same (not where a value came from).
STATE_KEY = ("type", "spring", "path", "to")
#: Rows of one area, twice as many metres wide, are connected by one task first.
AREA_M = 50_000.0


def mint_ref(refs: Column) -> Column:
    """The reference an id is minted from: the first of the map's own (``node/1``, or with ``osm:`` before it), else the lowest."""
    own = F.filter(refs, lambda r: ~F.contains(r, F.lit(":")) | r.startswith("osm:"))
    return F.coalesce(F.regexp_replace(F.get(own, F.lit(0)), "^osm:", ""), F.array_min(refs))


def resolve(records: DataFrame, registry: DataFrame) -> DataFrame:
    """``records`` (key, refs) with ``spring`` and ``how`` (known, moved or minted), as if they came one by one in the order of their keys.

    ``registry``: entry (its order), spring, refs.  A record takes the spring that holds the first of its
    references that any holds: entries of the registry (the last one that lists it), or what earlier
    records took (known).  Else, where both tables have lat, lng, name and kind, the first entry that is the
    same spring by place and name and that no earlier record took (moved).  Else it gets an id
    minted from ``mint_ref``.  Either way all references of its spring are the spring's from then on.  A
    record to be minted without any reference, or an id that is taken already, fails the job.

    Whether a record finds a reference needs no order: some entry or earlier record must have it.  Records,
    references and entries that are connected are worked out apart from all others.  Where they
    have one spring in all, nothing needs an order either.  Only groups with several springs are gone through
    in order, as one sorted stream a task that holds the references of one group.  Rows of equal
    place, name and kind are one node, and pairs are made of these, so many records at one place are no
    many pairs, and rounds grow with the logarithm of the longest chain.
    """
    placed = {"lat", "lng", "name", "kind"} <= set(records.columns) & set(registry.columns)
    records = _with_class(records.withColumn("_mint", mint_id(mint_ref(F.col("refs")))), placed)
    entries = written(_with_class(registry, placed).select("entry", "spring", "refs", "_class", "_place"), "entries")
    # files are a fraction of their rows: no join trusts Spark's estimate of the size, which would broadcast them through the driver
    wanted = records.select("key", F.explode(F.array_distinct("refs")).alias("ref"))
    first = wanted.groupBy("ref").agg(F.min("key").alias("first"))
    listed = entries.select(F.explode("refs").alias("ref")).distinct().withColumn("listed", F.lit(True))
    told = wanted.join(first.hint("merge"), "ref").join(listed.hint("merge"), "ref", "left").groupBy("key").agg(F.bool_or(F.coalesce("listed", F.lit(False)) | (F.col("first") < F.col("key"))).alias("found"))
    marked = written(records.join(told.hint("merge"), "key", "left").select("key", "refs", "_mint", "_class", "_place", F.coalesce("found", F.lit(False)).alias("found")), "records")
    starters = marked.where("not found")

    # one graph of references and classes; an entry or record is at the node of its first reference, or of its class
    here = F.coalesce(F.xxhash64(F.get("refs", F.lit(0))), F.xxhash64(F.lit("class"), "_class"))
    area = F.when(F.col("_place").isNotNull(), F.xxhash64(cell(F.col("_place.lat"), F.col("_place.lng"), AREA_M))) if placed else F.lit(None).cast("long")
    both = marked.select("refs", "_class", "_place", "found").unionByName(entries.select("refs", "_class", "_place", F.lit(False).alias("found"))).withColumn("area", F.coalesce(area, here))
    edges = both.select(here.alias("a"), F.explode(F.transform("refs", lambda r: F.xxhash64(r))).alias("b"), "area")
    pairs = None
    if placed:
        pairs = written(_class_pairs(starters, entries), "classes")
        node = lambda c: F.xxhash64(F.lit("class"), c)
        edges = edges.unionByName(both.where("not found and _class is not null").select(here.alias("a"), node("_class").alias("b"), "area")).unionByName(pairs.select(node("record_class").alias("a"), node("entry_class").alias("b"), "area"))
    roots = components(edges, shuffled=True, near=["area"])

    def rooted(rows: DataFrame, node: Column) -> DataFrame:
        return rows.withColumn("_node", node).join(roots.hint("merge"), F.col("_node") == roots["node"], "left").withColumn("root", F.coalesce("root", "_node")).drop("_node", "node")

    records_in, entries_in = rooted(marked, here), rooted(entries, here)
    sources = records_in.where("not found").select("root", F.col("_mint").alias("spring"), F.lit("minted").alias("how")).unionByName(entries_in.select("root", "spring", F.lit("known").alias("how")))
    groups = written(sources.groupBy("root").agg(F.count("*").alias("n"), F.min("spring").alias("spring"), F.min("how").alias("how")), "groups")
    alone = records_in.join(groups.where("n = 1").hint("merge"), "root").select("key", "spring", F.when(~F.col("found"), "minted").otherwise("known").alias("how"))

    crowded = groups.where("n > 1").select("root").hint("merge")
    none = lambda kind: F.lit(None).cast(kind)
    stream = records_in.join(crowded, "root").select("root", F.lit(2).alias("part"), F.col("key").cast("long").alias("at"), "refs", F.col("_mint").alias("spring"), F.col("_class").alias("cls"), none("string").alias("other"))
    stream = stream.unionByName(entries_in.join(crowded, "root").select("root", F.lit(0).alias("part"), F.col("entry").cast("long").alias("at"), "refs", "spring", F.col("_class").alias("cls"), none("string").alias("other")))
    if placed:
        links = rooted(pairs, node("record_class")).join(crowded, "root")
        stream = stream.unionByName(links.select("root", F.lit(1).alias("part"), none("long").alias("at"), none("array<string>").alias("refs"), none("string").alias("spring"), F.col("record_class").alias("cls"), F.col("entry_class").alias("other")))
    # by a column of its own: Spark leaves out a repartition by "root" where all parts of the union come from joins by it, and then reads their partitions apart
    ordered = stream.repartition(F.xxhash64("root")).sortWithinPartitions("root", "part", "at").mapInArrow(_in_order, "key long, spring string, how string")
    kind = dict(records.dtypes)["key"]
    found = written(alone.unionByName(ordered.select(F.col("key").cast(kind).alias("key"), "spring", "how")), "resolved")

    # two references of one hash, or an id of the registry again
    minted = found.where("how = 'minted'")
    taken = minted.select("spring").unionByName(entries.select("spring").join(minted.select("spring").hint("merge"), "spring", "left_semi")).groupBy("spring").count().where("count > 1")
    clash = taken.agg(F.max("spring").alias("clash")).first()["clash"]
    if clash is not None:
        raise ValueError(f"two references mint the id {clash}")
    sound = F.when((F.col("how") == "minted") & F.col("spring").isNull(), F.raise_error(F.concat(F.lit("no reference to mint an id from: record "), F.col("key").cast("string")))).otherwise(F.col("spring"))
    return marked.select("key", "refs").join(found.hint("merge"), "key").select("key", "refs", sound.alias("spring"), "how")


def _with_class(rows: DataFrame, placed: bool) -> DataFrame:
    """``rows`` with ``_place`` (lat, lng, name, kind; the name normalised) and ``_class``, a text that stands for it; null without a position."""
    if not placed:
        return rows.withColumns({"_class": F.lit(None).cast("string"), "_place": F.lit(None).cast("string")})
    place = F.struct(F.col("lat").alias("lat"), F.col("lng").alias("lng"), norm_name(F.col("name")).alias("name"), F.col("kind").alias("kind"))
    known = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return rows.withColumn("_place", F.when(known, place)).withColumn("_class", F.to_json("_place"))


def _class_pairs(starters: DataFrame, entries: DataFrame) -> DataFrame:
    """(record_class, entry_class, area of the record): places that are the same spring."""
    mine = starters.where("_class is not null").select("_class", "_place").distinct().select(F.col("_class").alias("record_class"), "_place.*")
    theirs = entries.where("_class is not null").select("_class", "_place").distinct().select(
        F.col("_class").alias("entry_class"), F.col("_place.lat").alias("r_lat"), F.col("_place.lng").alias("r_lng"), F.col("_place.name").alias("r_name"), F.col("_place.kind").alias("r_kind")
    )
    d = distance_m(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))
    return radius_join(mine, theirs, SAME_NAME_M).where(same_spring(F.col("name"), F.col("r_name"), F.col("kind"), F.col("r_kind"), d)).select("record_class", "entry_class", F.xxhash64(cell(F.col("lat"), F.col("lng"), AREA_M)).alias("area"))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, spring, how) of groups that arrive one after another: entries, pairs of classes, records by key."""
    root = None
    for batch in batches:
        out: list[tuple[int, str | None, str]] = []
        for new, part, at, refs, spring, cls, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if new != root:
                root = new
                holder: dict[str, str] = {}  # reference: the spring it belongs to
                held: dict[str, set] = defaultdict(set)  # spring: its references
                lost: dict[str, set] = defaultdict(set)  # spring: those that belong to another one now
                seen: set[str] = set()
                queue: dict[str, deque] = defaultdict(deque)  # class: entries in order
                near: dict[str, list] = defaultdict(list)
            refs = refs or ()
            if part == 0:
                for ref in refs:
                    if (before := holder.get(ref)) not in (None, spring):
                        lost[before].add(ref)
                    holder[ref] = spring
                    held[spring].add(ref)
                queue[cls].append((at, spring))
                continue
            if part == 1:
                near[cls].append(other)
                continue
            own = spring
            spring, how = next((holder[x] for x in refs if x in holder), None), "known"
            if spring is None:
                heads = []
                for c in near.get(cls, ()):
                    while queue[c] and queue[c][0][1] in seen:
                        queue[c].popleft()
                    if queue[c]:
                        heads.append(queue[c][0])
                spring, how = (min(heads)[1], "moved") if heads else (own, "minted")
            for ref in {*refs, *lost.pop(spring, ())}:
                if (before := holder.get(ref)) not in (None, spring):
                    lost[before].add(ref)
                holder[ref] = spring
                held[spring].add(ref)
            seen.add(spring)
            out.append((at, spring, how))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["key", "spring", "how"])


def advance(registry: DataFrame, resolved: DataFrame, today: str, merges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The next registry and the events of the change, (spring, type, to, ts).

    ``registry``: spring, entry, refs, lat, lng, name, first_seen, last_seen, missing_since, merged_into.  ``resolved``: key (a
    long), spring, refs, lat, lng, name.  A spring's records add their references (sorted); the last one gives
    the position, the last named one the name.  Entries without a record are kept and marked as missing.
    ``merges`` (ref, into): what was absorbed by another spring; the first entry that holds the reference
    says which, and its disappearance is a merge.  An entry that is back loses that mark.  New entries come last,
    in the order of their first keys.
    """
    last = resolved.groupBy("spring").agg(
        F.min("key").alias("_key"), F.max_by(F.struct("lat", "lng"), "key").alias("_at"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("key"))).alias("_name")
    )
    refs = resolved.select("spring", F.explode("refs").alias("ref")).groupBy("spring").agg(F.collect_set("ref").alias("_refs"))
    most = registry.agg(F.max("entry").alias("m")).first()["m"]
    least = resolved.agg(F.min("key").alias("m")).first()["m"]
    both = registry.join(last.join(refs, "spring", "left"), "spring", "full_outer")
    here, new = F.col("_key").isNotNull(), F.col("first_seen").isNull()
    empty = F.array().cast("array<string>")
    after = both.select(
        "spring", F.coalesce("entry", F.lit((-1 if most is None else most) + 1 - (least or 0)) + F.col("_key")).alias("entry"),
        F.when(here, F.array_sort(F.array_union(F.coalesce("refs", empty), F.coalesce("_refs", empty)))).otherwise(F.col("refs")).alias("refs"),
        F.when(here, F.col("_at.lat")).otherwise(F.col("lat")).alias("lat"), F.when(here, F.col("_at.lng")).otherwise(F.col("lng")).alias("lng"), F.coalesce("_name", "name").alias("name"),
        F.coalesce("first_seen", F.lit(today)).alias("first_seen"), F.when(here, F.lit(today)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(~here, F.coalesce("missing_since", F.lit(today))).alias("missing_since"), F.when(~here, F.col("merged_into")).alias("merged_into"),
        F.when(new, "spring.appeared").when(~here & F.col("missing_since").isNull(), "spring.disappeared").alias("_type"),
    )
    after = written(after, "registry")
    if merges is not None:
        holders = after.select("spring", "entry", F.explode("refs").alias("ref")).join(merges, "ref")
        # several bindings of one entry: the last in order of their references stays
        chosen = holders.groupBy("ref", "into").agg(F.min_by("spring", "entry").alias("spring")).where("spring <> into").groupBy("spring").agg(F.max_by("into", "ref").alias("_into"))
        after = after.join(chosen, "spring", "left").withColumn("merged_into", F.coalesce("_into", "merged_into"))
        merged = (F.col("_type") == "spring.disappeared") & F.col("_into").isNotNull()
        after = after.withColumn("_to", F.when(merged, F.col("_into"))).withColumn("_type", F.when(merged, "spring.merged").otherwise(F.col("_type"))).drop("_into")
    else:
        after = after.withColumn("_to", F.lit(None).cast("string"))
    events = after.where("_type is not null").select("spring", F.col("_type").alias("type"), F.col("_to").alias("to"), F.lit(today).alias("ts"))
    return after.drop("_type", "_to"), events


def merge_links(events: DataFrame) -> DataFrame:
    """(old, new) by the event log (spring, type, to, ts): what each spring was merged into last, if it didn't come back after that."""
    told = events.where(F.col("type").isin("spring.merged", "spring.appeared", "spring.returned"))
    last = told.groupBy("spring").agg(F.max_by(F.struct("type", "to"), F.struct("ts", (F.col("type") == "spring.merged").cast("int"), "to")).alias("e"))
    return last.where("e.type = 'spring.merged' and e.to is not null").select(F.col("spring").alias("old"), F.col("e.to").alias("new"))


def current_ids(links: DataFrame) -> DataFrame:
    """(old, current): where each old id leads in the end, over any number of merges; null for ids that lead in a circle.

    ``links``: old (each once), new.  A round doubles the steps, so rounds grow with the logarithm of the longest
    chain; a round that brings no id to its end leaves only circles.
    """
    jumps, before = written(links.select("old", F.col("new").alias("current")), "aliases"), None
    while True:
        onward = jumps.select(F.col("old").alias("_old"), F.col("current").alias("_next"))
        jumps = written(jumps.select("old", "current").join(onward, F.col("current") == F.col("_old"), "left").select("old", F.coalesce("_next", "current").alias("current"), F.col("_next").isNotNull().alias("on")), "aliases")
        left = jumps.where("on").count()
        if left in (0, before):
            return jumps.select("old", F.when(~F.col("on"), F.col("current")).alias("current"))
        before = left


def lifecycle(registry: DataFrame, present: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """The next registry and the events of the change.

    ``registry``: spring, first_seen, last_seen, missing_since; ``present``: spring.
    """
    both = registry.join(present.select("spring").distinct().withColumn("_here", F.lit(True)), "spring", "full_outer")
    here, new = F.coalesce("_here", F.lit(False)), F.col("first_seen").isNull()
    after = both.select(
        "spring", F.coalesce("first_seen", F.lit(today)).alias("first_seen"), F.when(here, F.lit(today)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(here, F.lit(None).cast("string")).otherwise(F.coalesce("missing_since", F.lit(today))).alias("missing_since"),
        F.when(new, "spring.appeared").when(here & F.col("missing_since").isNotNull(), "spring.returned").when(~here & F.col("missing_since").isNull(), "spring.disappeared").alias("type"),
    )
    return after.drop("type"), after.where("type is not null").select("spring", "type", F.lit(today).alias("ts"))


def new_events(batch: DataFrame, history: DataFrame, order: str = "ts") -> DataFrame:
    """The batch's events whose state key is neither in the history nor earlier in the batch."""
    keys = list(STATE_KEY)
    first = F.row_number().over(W.partitionBy(*keys).orderBy(order, "event_id"))
    fresh = batch.withColumn("_rank", first).where("_rank = 1").drop("_rank")
    same = None
    for k in keys:
        test = F.col(f"_h_{k}").eqNullSafe(F.col(k))
        same = test if same is None else same & test
    old = history.select(*[F.col(k).alias(f"_h_{k}") for k in keys]).distinct()
    return fresh.join(old, same, "left_anti")
