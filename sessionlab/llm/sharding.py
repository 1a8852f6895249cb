"""Sharding by jump consistent hashing: a stable key and the number of shards decide the shard, without a ring table.

With one more shard, a key either stays or moves into the new shard, and 1 / shards of the keys move. Everything is
column expressions: the key's 64-bit hash runs through the published generator (multiplier 2862933555777941757), each
step of which gives the number of shards at which the key jumps next. Rows that repeat a key share its shard. A row
whose key columns are all null goes by the hash of its text instead, so such rows spread as well.

Slots number the rows of a shard from 0 in the order of key hash, key, checksum and size; equal rows may swap places.
They come from one range sort of narrow rows, not from a window per shard: a shard holds a fixed share of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlab.llm.common import stored

_MULTIPLIER, _MODULUS, _SHIFT = Decimal(2862933555777941757), Decimal(1 << 64), Decimal(1 << 33)
_UNSIGNED = "decimal(20,0)"


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (int, from 0) of a 64-bit key among ``shards``; null for a null key.

    At most ``shards`` jumps, their logarithm on average: two nested loops over about the root of ``shards`` each, which
    stop jumping once the key has landed.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    wide = key.cast(_UNSIGNED)
    unsigned = F.when(wide < 0, wide + F.lit(_MODULUS)).otherwise(wide).cast(_UNSIGNED)
    begin = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"), unsigned.alias("key"))

    def jump(s: Column) -> Column:
        following = ((s["key"] * F.lit(_MULTIPLIER) + F.lit(Decimal(1))) % F.lit(_MODULUS)).cast(_UNSIGNED)
        # One array element, so that the product is computed once a jump and read twice.
        return F.get(F.transform(F.array(following), lambda k: F.struct(
            s["next"].alias("at"),
            F.floor((s["next"] + 1).cast("double") * (
                F.lit(float(1 << 31)) / (F.call_function("div", k, F.lit(_SHIFT)) + 1).cast("double"))).alias("next"),
            k.alias("key"))), F.lit(0))

    def landed(s: Column) -> Column:
        return s["next"] >= shards

    side = math.isqrt(shards - 1) + 1
    turns = F.sequence(F.lit(1), F.lit(side))

    def rounds(s: Column, _: Column) -> Column:
        return F.when(landed(s), s).otherwise(
            F.aggregate(turns, s, lambda t, _: F.when(landed(t), t).otherwise(jump(t))))
    return F.when(key.isNotNull(), F.aggregate(turns, begin, rounds)["at"].cast("int"))


def stable_key(keys: Sequence[str], text: str = "text") -> Column:
    """64-bit hash of the key columns; of the text where all of them are null."""
    columns = [F.col(f"`{k}`") for k in keys]
    nothing = reduce(Column.__and__, [c.isNull() for c in columns])
    return F.when(nothing, F.xxhash64(F.lit("text"), F.col(f"`{text}`"))).otherwise(F.xxhash64(*columns))


def assign_shards(docs: DataFrame, shards: int = 24, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (with one shard more); columns of these names are replaced."""
    key = stable_key(keys, text)
    return docs.withColumns({"shard": jump_hash(key, shards), "grown_shard": jump_hash(key, shards + 1)})


def with_slots(rows: DataFrame, order: Sequence[str | Column], shard: str = "shard", name: str = "slot") -> DataFrame:
    """``rows`` with ``name``: their number within the shard, from 0 without gaps, in ``order``.

    The position inside a sorted task, plus the rows of the shard in the tasks before it. A task holds a few shards, so
    the table of sizes has one row for each task and one for each shard, and is joined as its measured size allows.
    """
    columns = rows.columns
    numbered = rows.withColumn("__tie", F.monotonically_increasing_id())
    ordered = numbered.orderBy(shard, *order, "__tie").withColumn("__at", F.monotonically_increasing_id())
    placed = stored(ordered, "shards").withColumn("__task", F.shiftright("__at", 33))
    sizes = placed.groupBy(shard, "__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(shard).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    return placed.join(starts, [shard, "__task"]).select(
        *columns, (F.col("__at") - F.col("__first") + F.col("__offset")).alias(name))


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, plus 8), text_crc32, shard, grown_shard and slot of every document.

    Null text has no bytes. Texts are read once and only these narrow rows are sorted.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    narrow = assign_shards(docs, shards, text=text).select(
        "doc_id", (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        "shard", "grown_shard")
    return with_slots(narrow, [F.xxhash64("doc_id"), "doc_id", "text_crc32", "size"])


def moved(docs: DataFrame, shards: int, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The rows that one more shard takes over, with where they are and where they go: all else stays in place."""
    return assign_shards(docs, shards, keys, text).where("shard <> grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, keys: Sequence[str] = ("doc_id",), text: str = "text",
                 rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` as Parquet below ``path/shard=k``, in files of about ``rows_per_file`` rows at most.

    Rows are dealt by shard and a piece of it, so that a shard is written by many tasks and few files.
    """
    key = stable_key(keys, text)
    pieces = max(1, -(-docs.count() // (shards * rows_per_file)))
    placed = docs.withColumn("shard", jump_hash(key, shards)).withColumn(
        "__piece", F.pmod(F.monotonically_increasing_id(), F.lit(pieces)))
    placed.repartition(shards * pieces, "shard", "__piece").drop("__piece").write.option(
        "maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
