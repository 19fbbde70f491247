"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight schedule is integrated into a cumulative demand curve; a
document copy's training position is the time at which that curve reaches the
middle of the copy.  Documents are sorted by range on that position.

Hot sources are no hot tasks: prefix sums run inside 4,096 slices of a
source, by the first digits of md5(doc_id), and a table of slice sums joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, bounded_batches, saved, utf8

WEIGHTS = (5, 2, 1)
#: Relative weight at the start, middle and end of training, for the sources of
#: each weight in turn; straight lines between.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
MOST_REPEATS = 3
#: Columns that ``mix`` and what follows it add.
ADDED = (
    "mix_size", "mix_source_size", "mix_target", "mix_positions", "mix_taken", "mix_key", "mix_slice", "mix_middle", "mix_s_source", "mix_s_slice", "mix_t_source", "mix_before", "mix_rank",
    "mix_row", "mix_position", "mix_at", "mix_bytes", "mix_part", "mix_in", "mix_inside", "mix_first", "mix_first_rank", "mix_last_rank",
)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, rank, target from (source, size) rows.

    Water-filling: a source's cap is ``repeats`` times its size.  With sources
    in ascending order of cap / weight, the capped ones come first; the others
    share what is left by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source, so these windows are small
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("rank"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    by_need = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = W.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    share = F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing))
    levels = ranked.withColumn("level", left / share)
    # the level of the first source that its cap does not bind
    free = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"]
    return levels.select("source", "source_size", "rank", F.least("cap", F.col("weight") * F.coalesce(free, F.lit(0.0))).alias("target"))


def demand_time(share: Column, kind: Column) -> Column:
    """The time in [0, 1] at which a schedule's integral reaches ``share`` of its whole.

    Each half of a schedule is a straight line, so the integral is a parabola
    and its inverse a square root.
    """

    def inverse(a: float, b: float, c: float) -> Column:
        first, second = (a + b) / 4, (b + c) / 4
        need = share * (first + second)

        def half(y: Column, w0: float, w1: float, start: float) -> Column:
            slope = (w1 - w0) / 0.5
            u = y / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * y, F.lit(0.0))) - w0) / slope
            return start + F.least(F.greatest(u, F.lit(0.0)), F.lit(0.5))

        return F.when(need <= first, half(need, a, b, 0.0)).otherwise(half(need - first, b, c, 0.5))

    out = F.lit(None).cast("double")
    for k, schedule in enumerate(SCHEDULES):
        out = F.when(kind == k, inverse(*schedule)).otherwise(out)
    return out


def compressed(rows: DataFrame) -> DataFrame:
    """``rows`` with each text as a zstandard frame: they travel twice, by source and by position."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in rows.schema])
    names = list(rows.columns)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        made = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            frames = pa.array([made.compress(x) for x in utf8(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([frames if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return bounded_batches(rows).mapInArrow(run, schema)


def mix(docs: DataFrame, compress: bool = False) -> DataFrame:
    """All rows of ``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``,
    ``mix_positions`` (one position per copy taken, ascending) and ``mix_taken``.

    Sources in order of code points, null last, have ``WEIGHTS`` in turn and
    share the words of all documents; nobody's target exceeds ``MOST_REPEATS``
    times its size.  A source is read over and over in the order of
    md5(doc_id); a copy is taken if its middle is within the target.  Null text
    and empty text have size 0 and are never taken; repeated rows are taken
    each for itself; an empty table gives no rows.  Other columns pass through,
    but those named as the added ones are replaced.  With ``compress`` the texts
    come as zstandard frames.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # three hexadecimal digits: 4,096 slices
    sized = docs.drop(*ADDED).withColumns({"mix_size": size, "mix_key": key}).withColumn("mix_slice", F.substring("mix_key", 1, 3))
    slices = sized.groupBy(F.col("source").alias("mix_s_source"), F.col("mix_slice").alias("mix_s_slice")).agg(F.sum("mix_size").alias("size"))
    targets = source_targets(slices.select(F.col("mix_s_source").alias("source"), "size")).select(
        F.col("source").alias("mix_t_source"), F.col("source_size").alias("mix_source_size"), F.col("rank").alias("mix_rank"), F.col("target").alias("mix_target")
    )
    before = F.sum("size").over(W.partitionBy("mix_s_source").orderBy("mix_s_slice")) - F.col("size")
    slices = slices.withColumn("mix_before", before).drop("size")
    slices = slices.join(targets, F.col("mix_s_source").eqNullSafe(F.col("mix_t_source"))).drop("mix_t_source")
    if compress:
        sized = compressed(sized)
    sized = sized.join(slices, F.col("source").eqNullSafe(F.col("mix_s_source")) & (F.col("mix_slice") == F.col("mix_s_slice")))
    inside = W.partitionBy("mix_s_source", "mix_s_slice").orderBy("mix_key", F.col("doc_id").asc_nulls_first(), "mix_size").rowsBetween(W.unboundedPreceding, 0)
    middle = F.col("mix_before") + F.sum("mix_size").over(inside) - F.col("mix_size") / 2
    sized = sized.withColumn("mix_middle", middle)
    reads = F.array(*[F.lit(float(e)) for e in range(MOST_REPEATS)])
    middles = F.filter(F.transform(reads, lambda e: e * F.col("mix_source_size") + F.col("mix_middle")), lambda m: (m <= F.col("mix_target")) & (F.col("mix_size") > 0))
    positions = F.transform(middles, lambda m: demand_time(m / F.col("mix_target"), F.col("mix_rank") % len(SCHEDULES)))
    return sized.withColumn("mix_positions", positions).withColumn("mix_taken", F.size("mix_positions") * F.col("mix_size")).drop(
        "mix_key", "mix_slice", "mix_middle", "mix_s_source", "mix_s_slice", "mix_before", "mix_rank"
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy taken, with ``mix_position``, sorted by range on it."""
    rows = mixed.withColumn("mix_position", F.explode("mix_positions")).drop("mix_positions")
    return rows.repartitionByRange(F.col("mix_position"), F.col("doc_id")).sortWithinPartitions("mix_position", "doc_id", "mix_size")


def with_ranks(mixed: DataFrame) -> DataFrame:
    """``mixed`` without its text, with ``mix_first`` (the first copy's position) and ``mix_first_rank``,
    ``mix_last_rank``: the places of the first and last copy in the training order, from 0; null where none is taken.

    Whole documents are sorted; only what is left without the text is written.  A
    table of partition sizes turns places inside a partition into places in the
    order.  Rows that are not taken lie anywhere among the others and count for
    nothing.
    """
    rows = mixed.withColumn("mix_row", F.monotonically_increasing_id()).withColumn("mix_position", F.explode_outer("mix_positions"))
    anywhere = F.pmod(F.xxhash64("mix_row"), F.lit(1 << 20)) / (1 << 20)
    order = rows.withColumn("mix_at", F.coalesce("mix_position", anywhere)).repartitionByRange(F.col("mix_at"), F.col("doc_id")).sortWithinPartitions("mix_at", "doc_id", "mix_size")
    order = order.withColumn("mix_bytes", F.octet_length("text")).drop("text", "mix_positions", "mix_at")
    order = saved(order.withColumns({"mix_part": F.spark_partition_id(), "mix_in": F.monotonically_increasing_id()}), "order").drop("mix_bytes")
    taken = F.col("mix_position").isNotNull()
    sizes = order.where(taken).groupBy("mix_part").agg(F.count("*").alias("mix_n"))
    # one row a partition, so this window is small
    before = sizes.select("mix_part", (F.sum("mix_n").over(W.orderBy("mix_part")) - F.col("mix_n")).alias("mix_before"))
    inside = F.sum(taken.cast("long")).over(W.partitionBy("mix_part").orderBy("mix_in"))
    ranked = order.withColumn("mix_inside", inside).join(F.broadcast(before), "mix_part", "left")
    rank = F.when(taken, F.col("mix_before") + F.col("mix_inside") - 1)
    kept = [c for c in mixed.columns if c not in ("text", "mix_positions")]
    return ranked.groupBy("mix_row").agg(
        *[F.first(c).alias(c) for c in kept], F.min("mix_position").alias("mix_first"), F.min(rank).alias("mix_first_rank"), F.max(rank).alias("mix_last_rank")
    ).drop("mix_row")
