"""Helpers shared by the operators: shared scratch space, words, row splits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but blank and the ASCII controls 9-13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set.

    Only where the session names none (tests on one machine) a temporary
    folder is made and set as checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own_dirs and (named := spark.sparkContext.getCheckpointDir()):
        return named
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Bytes of text that go to a Python worker at once.
BATCH_BYTES = "8m"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now sends small batches to Python: whole texts are long rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


#: Spark's setting that deletes the shuffle files of a query when it ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without running
    the (Python) work above again, and every reader sees the same rows.  The
    shuffle files of ``df`` go once it is written; ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote for ``tables``, once nothing that is still to run reads them."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the filter of ``row_bits``: 2 MiB.
FILTER_BITS = 1 << 24


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def row_bits(rows: DataFrame, key: str) -> DataFrame:
    """(_part, _bits): a bitmap of the hashes of ``key``, as large for any number of rows, in parts of 4 KiB."""
    at = rows.select(F.bitmap_bucket_number(_bit(key)).alias("_part"), F.bitmap_bit_position(_bit(key)).alias("at"))
    return at.groupBy("_part").agg(F.bitmap_construct_agg("at").alias("_bits"))


def marked_by(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: false only where no row of ``bits`` (see ``row_bits``) has this ``key``.

    Nothing of ``df`` is shuffled, so few of its rows need to be for an exact join that follows.
    """
    at = F.bitmap_bit_position(_bit(key))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("_part", F.bitmap_bucket_number(_bit(key))).join(F.broadcast(bits), "_part", "left")
    return met.withColumn("_maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_part", "_bits")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null becomes b''."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Bytes of a key that may be broadcast: the hot table has at most so many a row.
HOT_KEY_BYTES = 64


def short_hot_split(table: DataFrame, weight: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """``hot_split`` of the keys of at most ``HOT_KEY_BYTES``; longer ones are all in the rest."""
    short = F.octet_length("key") <= HOT_KEY_BYTES
    hot, rest = hot_split(table.where(short), weight, limit)
    return hot, rest.unionByName(table.where(~short))


def hot_split(table: DataFrame, weight: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Split a (key, weight) table into its heaviest rows and the rest.

    At most ``limit`` rows are heavy.  Weights fall into bands of a sixteenth
    of an octave, at most a thousand, so only the band histogram reaches the
    driver.
    """
    band = F.floor(F.log2(F.greatest(F.col(weight), F.lit(1)).cast("double")) * 16)
    sizes = table.groupBy(band.alias("band")).count().collect()
    cut, total = None, 0
    for row in sorted(sizes, key=lambda r: -r["band"]):
        total += row["count"]
        if total > limit:
            break
        cut = row["band"]
    if cut is None:
        return table.where(F.lit(False)), table
    return table.where(band >= cut), table.where(band < cut)
