"""Sharding by jump consistent hashing, with DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published method: the linear congruential generator's multiplier, and 2^31 over the next value.
MULTIPLIER = 2862933555777941757
SALTS = 256


def _number(x: int) -> Column:
    return F.lit(Decimal(x))


def _unsigned(key: Column) -> Column:
    """A long as the unsigned number of the same bits; null counts as 0."""
    k = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)")
    return F.when(k < 0, k + _number(2**64)).otherwise(k).cast("decimal(20,0)")


def _next(key: Column) -> Column:
    product = key * _number(MULTIPLIER) + _number(1)
    return (product % _number(2**64)).cast("decimal(20,0)")


def _high(key: Column) -> Column:
    """The upper 31 bits."""
    return F.call_function("div", key, _number(2**33))


def jump_buckets(key: Column, shards: int) -> Column:
    """struct(now, grown): the bucket of key among `shards`, and among one more. Both lie on one walk of growing jumps:
    each is its last landing place below the number of shards."""
    start = F.struct(_unsigned(key).alias("k"), F.lit(0.0).alias("j"), F.lit(0).alias("now"), F.lit(0).alias("grown"))

    def step(s: Column, _: Column) -> Column:
        j = s["j"].cast("long")
        k = _next(s["k"])
        far = F.floor((s["j"] + 1) * (F.lit(float(2**31)) / (_high(k) + 1).cast("double"))).cast("double")
        walked = F.struct(
            k.alias("k"), far.alias("j"),
            F.when(j < shards, j.cast("int")).otherwise(s["now"]).alias("now"), j.cast("int").alias("grown"),
        )
        return F.when(s["j"] > shards, s).otherwise(walked)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: F.struct(s["now"], s["grown"]))


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): where each document goes, and its gapless place there.

    The key and the number of shards alone decide the shard; with one more shard only documents that move into it
    move. Places in a shard follow 256 sub-shards (eight further bits of the key's generator), then the key, so that
    a shard is ranked by 256 tasks. The sub-shards' counts, at most shards x 256 rows, are the only broadcast.
    A null key counts as 0 for hashing and stays null; a null text has no bytes and checksum 0; repeated rows get
    places of their own; other columns are not read."""
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    placed = d.withColumn("at", jump_buckets(F.col("doc_id"), shards)).withColumn(
        "salt", (F.call_function("div", _next(_unsigned(F.col("doc_id"))), _number(2**25)) % SALTS).cast("int")
    )
    placed = placed.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"), F.lit("key").alias("law"),
        F.col("at.now").alias("shard"), F.col("at.grown").alias("grown_shard"), "salt",
    )
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard", "salt",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "size", "text_crc32"))
    return (
        placed.withColumn("rank", rank).join(F.broadcast(before), ["shard", "salt"], "left")
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), "grown_shard")
    )


# The generator's walk as a recursive table; CRC-32 by its table of 256 steps, folded over the text's bytes.
ORACLE_SQL = """
with recursive walk as (
  select doc_id, (case when coalesce(doc_id, 0) < 0 then coalesce(doc_id, 0)::hugeint + 18446744073709551616 else coalesce(doc_id, 0)::hugeint end) as k,
    0::double as j, 0 as now, 0 as grown, null::hugeint as first_k
  from (select distinct doc_id from documents)
  union all
  select doc_id, k2, floor((j + 1) * (2147483648::double / ((k2 // 8589934592) + 1)::double)),
    case when j < 24 then j::int else now end, j::int, coalesce(first_k, k2)
  from (select *, (k * 2862933555777941757 + 1) % 18446744073709551616 as k2 from walk where j <= 24)
), spot as (
  select doc_id, now as shard, grown as grown_shard, ((first_k // 33554432) % 256)::int as salt from walk where j > 24
), crc_table as (
  select list(list_reduce(list_prepend(i::bigint, list_value(1, 2, 3, 4, 5, 6, 7, 8)::bigint[]),
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) order by i) as t
  from range(256) r(i)
), sized as (
  select doc_id, coalesce(octet_length(encode(text)), 0) + 8 as size, coalesce(xor(list_reduce(
     list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)),
     lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::bigint), 0) as text_crc32
  from documents, crc_table
)
select s.doc_id, s.size::bigint as size, s.text_crc32::bigint as text_crc32, 'key' as law, a.shard, a.grown_shard,
  row_number() over (partition by a.shard order by a.salt, s.doc_id nulls first, s.size, s.text_crc32) - 1 as slot
from sized s join spot a on s.doc_id is not distinct from a.doc_id
"""
