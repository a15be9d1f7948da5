"""Weighted rendezvous hashing of record keys over shards, and gapless slots inside each shard.

Every shard draws a number for every key; the key goes to the shard whose draw costs least for
its weight.  A draw depends on nothing but key and shard, so a further shard can only win keys
for itself, one that goes gives up only its own, and a shard of weight 2 gets twice the keys.

* Choosing a shard is row-local; no row moves for it and no table of shards is joined.
* Slots number the rows of a shard from 0 in the order of a hash of the whole row, in two levels:
  running counts inside fixed stretches of that hash, and a running total over the stretches.
  Equal rows are counted before the shuffle and told apart again in blocks dealt out to all
  tasks, so neither a key nor a row that makes up a third of the table meets in one task.
* Null keys are one key, different from the empty one.  Repeated rows get a slot each.  An empty
  table gives an empty result.  Only the columns asked for are read and kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notarium.operators import scan
from notarium.session import materialise

DRAW_BITS = 52  # whole numbers that a double holds exactly
PIECE_BITS = 12  # a shard is numbered in 2^12 stretches
BLOCK = 1 << 16  # equal rows told apart in one task


def draw(*values: Column) -> Column:
    """A number of 52 bits from the text of some values; null is a value of its own."""
    text = F.concat_ws(":", *[F.coalesce(v.cast("string"), F.lit("null")) for v in values])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def cost(key: Column, shard: Column, weight: Column) -> Column:
    """What a shard asks for a key: exponential with the shard's weight as its rate."""
    return -F.log((draw(key, shard) + 0.5) / float(1 << DRAW_BITS)) / weight


def choose(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard that asks least for a key; the lower number where two ask the same."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need weights above 0")
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(weights.items())])
    offers = F.transform(shards, lambda s: F.struct(cost(key, s["shard"], s["weight"]).alias("cost"), s["shard"].alias("shard")))
    return F.array_min(offers)["shard"]


def assign(rows: DataFrame, key: Column, weights: Mapping[int, float], name: str = "shard") -> DataFrame:
    """Add each row's shard as ``name``; a column of that name is replaced."""
    return rows.withColumn(name, choose(key, weights))


def slots(rows: DataFrame, within: Sequence[str] = ("shard",), name: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    All columns decide the order: by the hash of the row, then by its columns.  Columns of types
    that can't be grouped must be left out before.
    """
    columns, point, n, first = rows.columns, "_point", "_n", "_first"
    counted = rows.withColumn(point, draw(*[F.col(f"`{c}`") for c in columns])).groupBy(*[f"`{c}`" for c in columns], point).agg(
        F.count("*").alias(n))
    keys = list(within)
    pieces = counted.withColumn(scan.BUCKET, scan.bucket(point, DRAW_BITS - PIECE_BITS))
    before = F.coalesce(F.sum("_total").over(scan.earlier_buckets(keys)), F.lit(0))
    carry = pieces.groupBy(*keys, scan.BUCKET).agg(F.sum(n).alias("_total")).select(*keys, scan.BUCKET, before.alias("_carry"))
    running = F.sum(n).over(scan.upto(keys, point, *[f"`{c}`" for c in columns]))
    placed = scan.with_carry(pieces.withColumn("_upto", running), carry, keys).withColumn(
        first, F.col("_carry") + F.col("_upto") - F.col(n))
    # One row for up to BLOCK equal rows, dealt out before they are told apart.
    blocks = placed.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1, F.lit(BLOCK).cast("bigint"))))
    dealt = blocks.repartition(*keys, F.col(first) + F.col("_from"))
    last = F.least(F.col("_from") + BLOCK, F.col(n)) - 1
    return dealt.select(*[f"`{c}`" for c in columns], F.explode(
        F.sequence(F.col(first) + F.col("_from"), F.col(first) + last)).alias(name))


def shard_documents(docs: DataFrame, shards: int = 16, weights: Mapping[int, float] | None = None) -> DataFrame:
    """Documents over shards by their id alone, and where one more shard of weight 1 would put them.

    Returns doc_id, ``size`` (UTF-8 bytes and one more), ``text_crc32``, ``shard``, ``grown_shard``
    and ``slot``.  A null text has no bytes; a null id is a key of its own.
    """
    weights = dict(weights or {s: 1.0 for s in range(shards)})
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.col("doc_id")
    grown = weights | {max(weights) + 1: 1.0}
    # The texts are read once; both levels of slots read what is left of them.
    return slots(materialise(assign(assign(rows, key, weights), key, grown, "grown_shard"), "shards"))
