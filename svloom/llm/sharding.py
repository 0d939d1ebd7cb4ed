"""Sharding with a permutation-filled lookup table (Maglev hashing).

Each shard has a preference order over the slots of a prime-sized table: slot
(offset + j * skip) mod size, with offset and skip from the MD5 of its name.
Shards take turns; each claims its next preferred free slot until none is left.
Shards so get equal shares of slots to one slot, and when a shard leaves, few
slots of the others move. A row's slot is the hash of its key modulo the size,
and the table, whose size is a parameter, is broadcast: placement is one lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import free

#: Slots (a prime, over 100 for each shard) and shards of the production table.
TABLE_SIZE, SHARDS = 65_537, 256


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (its place in ``shards``) of every slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    if not _prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime, as many slots as shards at least")
    digest = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    at = [int(d[:15], 16) % size for d in digest]
    skip = [int(d[15:30], 16) % (size - 1) + 1 for d in digest]
    table, left = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def key_hash(*keys: Column) -> Column:
    """60 bits of the MD5 of the keys' text, 'null' for null, joined by unit separators."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the columns ``slot`` (long) and ``shard`` (a name of ``shards``) of every row.

    Rows of equal keys share a shard; a null key is hashed as 'null'. All other
    columns stay; a column that already has the name of an added one makes a
    ValueError. An empty table stays empty. The join is a broadcast of ``size``
    rows, whatever the data: no shuffle, and no key can make a task larger.
    """
    have = {c.lower() for c in df.columns}
    if clash := [c for c in (slot, shard) if c.lower() in have]:
        raise ValueError(f"columns {clash} exist already")
    at, no = (free([*df.columns, slot, shard], c) for c in ("_slot", "_no"))
    names = list(shards)
    # the table as text: split and numbered by Spark itself
    slots = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, lookup_table(names, size)))), ",")).alias(at, no))
    slots = slots.select(F.col(at).cast("long").alias(at), F.element_at(F.array(*map(F.lit, names)), F.col(no).cast("int") + 1).alias(shard))
    out = df.withColumn(slot, F.pmod(key_hash(*[df[k] for k in keys]), F.lit(size).cast("long")))
    return out.join(F.broadcast(slots), F.col(slot) == F.col(at)).select(*df.columns, slot, shard)
