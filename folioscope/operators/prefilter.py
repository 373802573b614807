"""A semi-join prefilter of fixed size, so that wide rows without a partner are not shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24  # 2 MB in all, whatever the input


def marked(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, flag: str, bits: int = BITS) -> DataFrame:
    """``df`` with boolean ``flag``: true for every row whose ``key`` is among ``keys``, and for a few others; false for null keys.

    The keys set bits of a bitmap with a proven size (``bits``), which is broadcast; the more keys, the more other rows
    are marked, so an exact join must follow.
    """
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    maps = keys.where(keys_key.isNotNull()).select(slot(keys_key).alias("__s")).groupBy(F.bitmap_bucket_number("__s").alias("__b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__s")).alias("__m"))
    s = df.withColumn("__s", slot(key)).withColumn("__b", F.bitmap_bucket_number("__s"))
    at = F.bitmap_bit_position("__s")
    byte = F.conv(F.hex(F.substring(F.col("__m"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("cast(shiftright(__v, cast(bitmap_bit_position(__s) % 8 as int)) & 1 as int)")
    out = s.join(F.broadcast(maps), "__b", "left").withColumn("__v", byte)
    return out.withColumn(flag, F.coalesce((bit == 1) & key.isNotNull(), F.lit(False))).drop("__s", "__b", "__m", "__v")


def probably_in(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, bits: int = BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys``: every row that is, and a few that are not."""
    return marked(df, key, keys, keys_key, "__maybe", bits).where("__maybe").drop("__maybe")
