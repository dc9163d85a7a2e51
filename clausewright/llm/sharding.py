"""Operator 9: weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a fixed uniform number u from MD5; a key goes to the shard with the least -ln(u) / weight.
A shard's numbers don't depend on the other shards, so a new shard takes rows only into itself and a removed
one gives up only its own rows.  A shard's expected share is its weight over the sum of weights.

Null keys count as the empty string (one key like any other); rows with equal keys share a shard; an empty table gives
no rows; columns of other names are ignored.  Weights must be positive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import pick

#: Rows of a shard are numbered in this many parts, so that no task orders a whole shard.  The table of part sizes has
#: shards x parts rows at most, which is what may be broadcast.
SLOT_PARTS = 1024


def rendezvous(key: Column, shards: int | Sequence[float]) -> Column:
    """The shard of a key.  `shards`: how many of equal weight, or the weights."""
    weights = [1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    equal = len(set(weights)) == 1
    ids = F.sequence(F.lit(0), F.lit(len(weights) - 1))

    def drawn(s: Column) -> Column:  # 52 bits of MD5
        return F.substring(F.md5(F.concat(text, F.lit(":"), s.cast("string")).cast("binary")), 1, 13)

    if equal:  # hex digits of one length order as their numbers do; the least -ln(u) is the largest u, the first shard wins ties
        best = F.array_max(F.transform(ids, lambda s: F.struct(drawn(s).alias("u"), (-s).alias("s"))))
        return (-best["s"]).cast("int")
    w = F.array(*[F.lit(x) for x in weights])
    u = lambda s: (F.conv(drawn(s), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    best = F.array_min(F.transform(ids, lambda s: F.struct((-F.log(u(s)) / F.element_at(w, s + 1)).alias("u"), s.alias("s"))))
    return best["s"].cast("int")


def shard(df: DataFrame, shards: int | Sequence[float], key: str = "doc_id", text: str = "text", grown: int | Sequence[float] | None = None) -> DataFrame:
    """Rows with `key`, size (UTF-8 bytes + 16), text_crc32, shard, and grown_shard for another shard list if given."""
    base = pick(df, key=key, text=text)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = base.select("key", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), rendezvous(F.col("key"), shards).alias("shard"), *([rendezvous(F.col("key"), grown).alias("grown_shard")] if grown is not None else []))
    return out.withColumnRenamed("key", key)


def number(df: DataFrame, order: Sequence[str], group: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without bringing a group into one task: rows of a group are split into
    SLOT_PARTS parts by the hash of the first order column, parts are sized, and a row's number is the rows of the parts before its own plus
    its place in its part."""
    first = F.coalesce(F.col(order[0]).cast("string"), F.lit(""))
    parted = df.withColumn("_part", (F.conv(F.substring(F.md5(first.cast("binary")), 1, 6), 16, 10).cast("int") % F.lit(SLOT_PARTS)))
    sizes = parted.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    place = Window.partitionBy(group, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = parted.withColumn("_rn", F.row_number().over(place))
    joined = placed.join(F.broadcast(offsets), (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(slot, (F.col("_from") + F.col("_rn") - 1).cast(T.LongType())).select(*df.columns, slot)


def shards_report(df: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return df.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
