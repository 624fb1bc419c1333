"""Shard placement by a lookup table that shards fill in turns, each in its own order of preference.

Every shard has an offset and a step in a table of prime size, hence a permutation
of all slots. Shards take turns; on its turn a shard claims the first slot of its
permutation that is still free. A key goes to the slot of its hash, so placement
is one hash and one lookup, and removing a shard moves few keys of other shards.
The table depends on the shard names and its size only, never on the data.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from understory.llm.common import aside

#: Largest table that is ever built; what is broadcast holds two integers a slot.
MAX_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and step of the shard's permutation of the slots."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def fill(shards: Sequence[str], slots: int) -> list[int]:
    """Index of the owning shard for every slot. ``slots`` must be prime and hold all shards."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be distinct, and there must be one")
    if not _is_prime(slots) or slots < len(shards) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime from {len(shards)} to {MAX_SLOTS}")
    orders = [preference(s, slots) for s in shards]
    turn, table, left = [0] * len(shards), [-1] * slots, slots
    while True:
        for i, (offset, step) in enumerate(orders):
            slot = (offset + turn[i] * step) % slots
            while table[slot] >= 0:
                turn[i] += 1
                slot = (offset + turn[i] * step) % slots
            table[slot], turn[i], left = i, turn[i] + 1, left - 1
            if not left:
                return table


def lookup(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """The table as rows ``slot``, ``shard``."""
    table = F.from_json(F.lit(json.dumps(fill(shards, slots))), "array<int>")
    names = F.from_json(F.lit(json.dumps(list(shards))), "array<string>")
    cells = spark.range(1).select(F.posexplode(table).alias("slot", "i"))
    return cells.select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("i")).alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo the table's size. A null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int, out: Sequence[str] = ("slot", "shard")) -> DataFrame:
    """All rows and columns of ``df``, and the slot and shard of each row's key.

    The table is broadcast: it has ``slots`` rows, ``MAX_SLOTS`` at most. Nothing is
    shuffled, so no key is too frequent. Equal keys get equal shards, also repeated
    rows. A null key is placed as empty text. An empty table gives no rows. Columns
    of ``df`` named as the outputs are replaced; other columns stay as they are.
    """
    slot, shard = out
    if slot == shard or key in out:
        raise ValueError("the outputs need two names other than the key's")
    kept = aside(df.drop(*out), _slot=slot_of(F.col(f"`{key}`"), slots))
    table = F.broadcast(lookup(df.sparkSession, shards, slots).select(F.col("slot").alias("_slot"), F.col("shard").alias("_shard")))
    return kept.join(table, "_slot").select("_row.*", F.col("_slot").alias(slot), F.col("_shard").alias(shard))


def moved(df: DataFrame, key: str, before: Sequence[str], after: Sequence[str], slots: int) -> DataFrame:
    """Rows per pair of shards (``old``, ``new``) when the shards change from ``before`` to ``after``."""
    old = place(df.select(F.col(f"`{key}`").alias("key")), "key", before, slots, ("old_slot", "old"))
    return place(old, "key", after, slots, ("new_slot", "new")).groupBy("old", "new").agg(F.count("*").alias("n_rows"))
