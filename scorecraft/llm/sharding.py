"""Sharding by a permutation-filled lookup table (consistent placement).

Every shard has its own order of preference over the slots of a table of prime
size; shards take turns, each claiming its next free slot, until the table is
full.  A key's hash picks a slot and the slot names the shard, so placement is
one look-up, shards are level within one slot per turn, and adding or removing
a shard moves few keys.  The table is configuration-sized (``slots`` rows) and
is broadcast; keys are hashed by DataFrame functions, without a shuffle.

Null keys are placed like the empty string; repeated keys always meet in one
shard; an empty table gives no rows; other columns are passed through, and a
column called ``slot`` or ``shard`` is replaced.
"""

from __future__ import annotations

import json
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537                 # prime, about 1,000 times the number of shards
MOST_SLOTS = 1_000_003         # proven bound of the broadcast table


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime between the number of shards and {MOST_SLOTS}")
    place, step = [], []
    for name in shards:
        digest = md5(name.encode()).digest()
        place.append(int.from_bytes(digest[:8], "big") % slots)
        step.append(int.from_bytes(digest[8:], "big") % (slots - 1) + 1)
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            owner[place[i]] = i
            free -= 1
            if not free:
                break
    return owner


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot int, shard string), built from literals on the JVM."""
    owner = json.dumps(lookup_table(shards, slots))
    return spark.sql(
        "SELECT slot, element_at(from_json(:shards, 'array<string>'), owner + 1) AS shard "
        "FROM (SELECT posexplode(from_json(:owner, 'array<int>')) AS (slot, owner))",
        args={"owner": owner, "shards": json.dumps(shards)})


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 15 hexadecimal digits of its MD5, modulo ``slots``."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)).cast("int")


def assign(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; the table is broadcast (at most
    ``MOST_SLOTS`` rows by construction)."""
    table = table_frame(df.sparkSession, shards, slots)
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return keyed.join(F.broadcast(table), "slot", "left")
