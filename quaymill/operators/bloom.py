"""A Bloom filter that is an ordinary table, built and probed with built-in expressions.

The filter has ``words`` words of 64 bits, ``BLOCK`` of them in a row. A key picks one word and sets ``PROBES`` of its
bits, so that one equi-join on the row tests a key. Its size depends on ``words`` alone, at most ``MAX_WORDS``: it may be
broadcast whatever the number of keys. With ``BITS_PER_KEY`` bits a key at most 0.5 % of other keys pass; that holds up to 33
million keys. Beyond them the share grows, to 1 % at 42 million, 3 % at 67 million and 9 % at 100 million. Past ``MOST_KEYS``
no filter is built: every key may be there, and the exact join decides alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 4
BITS_PER_KEY = 16
BLOCK = 64
#: 64 MB, in 2**17 rows.
MAX_WORDS = 1 << 23
MOST_KEYS = 100_000_000


def words_for(keys: int) -> int:
    """Words of a filter of ``keys``; 0 if none is worth building."""
    return 0 if keys > MOST_KEYS else min(MAX_WORDS, max(BLOCK, 1 << max(0, keys * BITS_PER_KEY // 64 - 1).bit_length()))


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(2))
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftright(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def build(keys: DataFrame, key: str, words: int) -> DataFrame:
    """Filter table ``(__block, __words array<bigint>)`` of the non-null values of ``key``."""
    k = F.col(key)
    bits = keys.where(k.isNotNull()).select(_word(k, words).alias("w"), _mask(k).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    at = F.col("w") % BLOCK
    rows = bits.groupBy(F.floor(F.col("w") / BLOCK).cast("int").alias("__block")).agg(F.map_from_entries(F.collect_list(F.struct(at, "m"))).alias("found"))  # at most BLOCK a row
    return rows.select("__block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.coalesce(F.col("found")[i], F.lit(0).cast("long"))).alias("__words"))


def probe(rows: DataFrame, key: str, keys: DataFrame, own: str, words: int, out: str) -> DataFrame:
    """``rows`` with the boolean ``out``: False proves that ``key`` is in no row of ``keys (own)``; null keys give False."""
    k = F.col(key)
    if not words:
        return rows.withColumn(out, k.isNotNull())
    w = _word(k, words)
    bits = F.get(F.col("__words"), w % BLOCK)
    hit = F.coalesce(bits.bitwiseAND(_mask(k)) == _mask(k), F.lit(False))
    near = rows.withColumn("__block", F.floor(w / BLOCK).cast("int"))
    return near.join(F.broadcast(build(keys, own, words)), "__block", "left").withColumn(out, k.isNotNull() & hit).drop("__block", "__words")


def may_hold(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without those whose ``key`` is surely in no row of ``keys (key)``: what is left before a join shuffles it. ``keys`` should be a written table."""
    return probe(rows, key, keys, key, words_for(keys.count()), "__may").where("__may").drop("__may")
