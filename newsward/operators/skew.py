"""Joins for uneven sizes: hot keys are spread, small sides broadcast after a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most this many keys are salted, which bounds the broadcast list of hot keys.
# Other keys keep salt 0 and are joined as usual, so the result is whole either way.
MAX_HOT_KEYS = 1000


# What a broadcast side may take in memory, as counted by its rows.
BROADCAST_BYTES = 256 * 1024 * 1024


def checked_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast if its rows fit ``BROADCAST_BYTES``, else leave it to
    a shuffled join. Counting stops just past the bound."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hot_keys(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """The keys of ``df`` with at least ``min_rows`` rows, most frequent first."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("key_rows"))
    often = counts.where(F.col("key_rows") >= min_rows)
    return often.orderBy(F.desc("key_rows"), key).limit(MAX_HOT_KEYS).select(key)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    salt_by: list[str],
    min_rows: int = 5_000_000,
    salts: int = 32,
) -> DataFrame:
    """Join on ``key`` where the left side may hold a huge share of rows under one key.

    The left side is read twice, for its frequent keys and for the join, so a costly
    one is best staged. Rows of a hot key, or of no key, get one of ``salts`` values from the columns ``salt_by``
    (which should tell rows apart); the right rows of that key are copied once per
    salt. Only right rows of hot keys are copied, so a large right side stays as it is.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join cannot copy right rows")
    hot = F.broadcast(hot_keys(left, key, min_rows).withColumn("key_is_hot", F.lit(True)))
    spread_rows = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    salted_left = left.join(hot, key, "left").withColumn(
        "salt", F.when(F.col("key_is_hot") | F.col(key).isNull(), spread_rows).otherwise(F.lit(0))
    )
    copies = F.when(F.col("key_is_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
    salted_right = right.join(hot, key, "left").withColumn(
        "salt", F.explode(F.coalesce(copies, F.array(F.lit(0))))
    )
    joined = salted_left.drop("key_is_hot").join(
        salted_right.drop("key_is_hot"), [key, "salt"], how
    )
    return joined.drop("salt")


# Bits of the map that stands for a set of keys: at most 2**21 rows of two numbers.
MAP_BITS = 27


def near_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key may be one of ``keys``, without moving any of them.

    ``keys`` becomes a bit map of bounded size, one bit per hashed key, which is broadcast.
    Every row of a key in ``keys`` passes, and some others, so an exact join must follow.
    """

    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(1 << MAP_BITS))

    bit = place(key).bitwiseAND(F.lit(63)).cast("int")
    masks = keys.groupBy(F.shiftright(place(key), 6).alias("map_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("map_mask")
    )
    marked = df.withColumn("map_word", F.shiftright(place(key), 6)).join(F.broadcast(masks), "map_word")
    return marked.where(F.getbit("map_mask", bit) == 1).drop("map_word", "map_mask")


def dimension_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    salt_by: list[str],
    row_bytes: int = 200,
) -> DataFrame:
    """Join a large left side to a dimension of unknown size: broadcast within the
    bound, which moves no left row, else by ``skew_join``."""
    counted = checked_broadcast(right, row_bytes)
    if counted is right:
        return skew_join(left, right, key, how, salt_by)
    return left.join(counted, key, how)
