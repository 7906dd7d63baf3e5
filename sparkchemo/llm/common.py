"""Helpers that the training-data operators share: scratch tables and text expressions."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters [\x20\x09-\x0D] as a string.
SPACES = " \t\n\x0b\f\r"
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); unset on one machine, as in tests, a temporary one, on a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='scratch')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and
    the rows stay as they were even if the plan above is not deterministic.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the folders of ``stored`` tables that no plan still to be run reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_folders.pop(table))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: log2 of the bits of a bitmap of ids (8 MB): with more ids it lets more rows through, and a join decides.
BITS = 26


def let_through(rows: DataFrame, ids: DataFrame, columns: list[str], inside: bool) -> DataFrame:
    """The ``rows`` that a bitmap of ``ids`` (both with ``columns``) lets through, or with ``inside`` false all others.

    The bitmap has 2 ** BITS bits at any size, so it can be broadcast; those let through are
    all that are asked for, and a few others.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(1 << BITS))
    bits = ids.select(slot.alias("_slot")).groupBy(F.floor(F.col("_slot") / 32768).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_slot") % 32768).alias("_bits"))
    bits = stored(bits, "bitmap")
    placed = rows.withColumn("_slot", slot).withColumn("_bucket", F.floor(F.col("_slot") / 32768)).join(F.broadcast(bits), "_bucket", "left")
    bit = F.col("_slot") % 32768
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return placed.where(has if inside else ~has).select(*rows.columns)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text; an empty array for null or blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def fold(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's decimal text, modulo ``buckets``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets
