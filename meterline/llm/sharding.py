"""Sharding by sampled splitters, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

RANGE_BYTES = 32 << 20  # what a range shall hold
MIN_RANGES, MAX_RANGES = 256, 65_536
SAMPLES_PER_RANGE = 32


def _unit(c):
    """A hash as a number from 0 to under 1."""
    return F.shiftrightunsigned(c, 11) * F.lit(2.0**-53)


def _before(value: str, order: str):
    """The sum over the rows that come earlier; for tables of bounded length only."""
    window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def splitter_cells(keyed: DataFrame, ranges: int, total: int) -> tuple[DataFrame, int]:
    """Quantile boundaries of the sampled keys, by cell: the leading bits of a key.

    A record of size s gives s / step draws, the fraction by the luck of its hash, so the sample
    has about ranges * SAMPLES_PER_RANGE draws whatever the input's size. Every cell has its
    splitters and the count of those before it, so a key finds its range by one equi-join.
    """
    step = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    draws = F.floor(F.col("size") / step + _unit(F.col("k2")))
    sample = keyed.select("k", draws.alias("draws")).where("draws > 0").groupBy("k").agg(F.sum("draws").alias("draws"))
    upto = F.sum("draws").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    nth = lambda c: F.floor(c / SAMPLES_PER_RANGE)
    bits = max(6, math.ceil(math.log2(ranges)))
    splitters = (
        sample.withColumn("upto", upto)
        .where(nth(F.col("upto")) > nth(F.col("upto") - F.col("draws")))
        .groupBy(F.shiftright("k", 64 - bits).alias("cell"))
        .agg(F.sort_array(F.collect_list("k")).alias("splitters"))
    )
    every = keyed.sparkSession.range(-(1 << (bits - 1)), 1 << (bits - 1), 1, 1).withColumnRenamed("id", "cell")
    none = F.array().cast("array<bigint>")
    cells = every.join(splitters, "cell", "left").select(
        "cell", F.coalesce("splitters", none).alias("splitters"), F.coalesce(F.size("splitters"), F.lit(0)).alias("n")
    )
    return cells.select("cell", "splitters", _before("n", "cell").alias("base")), bits


def shard(docs: DataFrame, shards: int = 8, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Deal ``docs`` (doc_id, text) into ``shards`` of nearly equal bytes.

    Records are ordered by the hash of their text, so equal texts are neighbours. A sample in
    which a record's chance grows with its size gives the boundaries of the ranges; records are dealt to
    ranges by them, and a range that holds over twice its share (many copies of one text) is
    subdivided by a hash of the record's number, so that repeated rows part as well. Running sums inside the ranges, on top of
    the ranges' own totals, put each record at its place in the whole order, which is cut into ``shards``
    of equal bytes. A shard's bytes differ from the mean by less than the largest record.

    Size is the text's UTF-8 bytes plus 1, 1 for null. Null ids, repeated ids and repeated
    rows are kept, each as a record of its own. Returns doc_id, size, text_crc32, law ('bytes'), shard,
    slot (from 0, gapless in each shard), grown_shard (null: this law promises nothing for other
    shard counts). An empty input gives no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = staged(
        docs.select(
            "doc_id",
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(raw).alias("k"),
            F.xxhash64(raw, F.col("doc_id").cast("string"), F.lit(1)).alias("k2"),
            F.xxhash64(F.monotonically_increasing_id()).alias("k3"),  # tells repeated rows apart, once written
        ),
        "sharding",
    )
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first().total
    ranges = max(MIN_RANGES, min(MAX_RANGES, math.ceil(total / range_bytes)))
    share = max(1.0, total / ranges)

    cells, bits = splitter_cells(keyed, ranges, total)
    dealt = (
        keyed.withColumn("cell", F.shiftright("k", 64 - bits))
        .join(F.broadcast(cells), "cell")  # at most 2 * MAX_RANGES rows
        .withColumn("range", F.col("base") + F.size(F.filter("splitters", lambda s: s < F.col("k"))))
    )
    overfull = (
        dealt.groupBy("range")
        .agg(F.sum("size").alias("held"))
        .where(F.col("held") > 2 * share)
        .select("range", F.ceil(F.col("held") / share).alias("parts"))
    )
    dealt = dealt.join(F.broadcast(overfull), "range", "left").withColumn(
        "part", F.coalesce(F.floor(_unit(F.col("k3")) * F.col("parts")), F.lit(0)).cast("long")
    )
    order = Window.partitionBy("range", "part").orderBy("k", "k2", "doc_id", "k3")
    rows = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.select(
        "doc_id", "size", "text_crc32", "range", "part",
        F.sum("size").over(rows).alias("upto"), F.row_number().over(order).alias("nth"),
    )
    # Ranges and their parts number at most about 3 * MAX_RANGES, whatever the input.
    starts = (
        dealt.groupBy("range", "part")
        .agg(F.sum("size").alias("bytes"))
        .withColumn("at", F.struct("range", "part"))
        .select("range", "part", _before("bytes", "at").alias("start"))
    )
    middle = F.col("start") + F.col("upto") - F.col("size") / 2
    cut = staged(
        placed.join(F.broadcast(starts), ["range", "part"]).withColumn(
            "shard", F.least(F.lit(shards - 1), F.floor(middle * shards / max(1, total))).cast("int")
        ).select("doc_id", "size", "text_crc32", "range", "part", "nth", "shard"),
        "sharding-cut",
    )
    # Slots: a shard's part of a range begins where its part of the earlier ranges ends.
    pieces = cut.groupBy("shard", "range", "part").agg(F.count("*").alias("rows"), F.min("nth").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return cut.join(F.broadcast(pieces), ["shard", "range", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("nth") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
