"""Sharding through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size (offset and step from its name's hash, so the order visits every slot).
The shards take turns; at its turn a shard claims the first slot of its order
that is still free, until no slot is left.  A row's key is hashed to a slot and
the table tells the shard: one lookup, whatever the number of shards, and all
shards own the same number of slots but for one.  When a shard goes, few slots
change hands between the others.

The table depends on the shards alone (never on the data) and has at most
MAX_SLOTS entries, so it is filled on the driver and broadcast; rows are placed
by built-in functions and a broadcast join, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the broadcast table.
MAX_SLOTS = 1 << 20
#: Hex digits of a hash that are used: 60 bits, so that numbers fit a BIGINT.
DIGITS = 15


def next_prime(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def table_size(shards: int) -> int:
    """The smallest prime of at least 100 slots a shard: shares differ by 1 % at most."""
    return next_prime(100 * shards)


def hashed(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:DIGITS], 16)


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """The owner (position in `shards`) of every slot.

    Equal names, an empty list, a size that isn't prime, is below the number of
    shards or above MAX_SLOTS: ValueError.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if size != next_prime(size) or not len(shards) <= size <= MAX_SLOTS:
        raise ValueError(f"the table's size must be a prime from {len(shards)} to {MAX_SLOTS}")
    place = [hashed(f"{s}:offset") % size for s in shards]
    step = [hashed(f"{s}:skip") % (size - 1) + 1 for s in shards]
    owner: list[int] = [-1] * size
    for claim in range(size):
        i = claim % len(shards)
        while owner[place[i]] >= 0:
            place[i] = (place[i] + step[i]) % size
        owner[place[i]] = i
    return owner


def lookup(spark: SparkSession, shards: Sequence[str], size: int | None = None) -> DataFrame:
    """(slot, shard) for every slot."""
    owner = fill_table(shards, size or table_size(len(shards)))
    names = F.array(*[F.lit(s) for s in shards])
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("slot", "i"))
    return slots.select(F.col("slot").cast("long"), F.element_at(names, F.col("i").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key; NULL counts as the empty string."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long") % F.lit(size)


def assign(df: DataFrame, key: str, shards: Sequence[str], size: int | None = None) -> DataFrame:
    """All rows and columns with `slot` and `shard` added; columns of `df` with these names are replaced (the key's after it is read).

    Equal keys (repeated rows) share a shard, NULL keys share one as well; an empty table stays empty.
    """
    size = size or table_size(len(shards))
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*others, slot_of(F.col(f"`{key}`"), size).alias("slot"))
    return placed.join(F.broadcast(lookup(df.sparkSession, shards, size)), "slot")


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, files: int = 8, size: int | None = None) -> None:
    """Write one folder per shard with up to `files` files; a salt from the whole row spreads a hot key over them."""
    placed = assign(df, key, shards, size)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files))
    dealt = placed.withColumn("_salt", salt).repartition("shard", "_salt").drop("_salt")
    dealt.write.partitionBy("shard").mode("overwrite").parquet(path)
