"""Consistent placement of documents by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size.  The shards
take turns; at its turn a shard claims the first slot of its order that is still free.  A key's
slot is its hash modulo the table size, so placing a document is one look-up, all shards hold
nearly the same number of slots, and a shard that comes or goes moves few of the others' slots.

The table depends on names and size only, never on the data: ``size`` rows of two small columns.
That is the bound under which it is broadcast.
"""

import hashlib

from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(128))
TABLE_SIZE = 16381


def digest(name, salt):
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards, size):
    """The shard of every slot; ``size`` must be a prime number and at least the number of shards."""
    if size < max(2, len(shards)) or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table size must be a prime number, and no smaller than the number of shards")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, and named differently")
    wish = [digest(name, "offset") % size for name in shards]
    stride = [digest(name, "stride") % (size - 1) + 1 for name in shards]
    owner, free = [None] * size, size
    while free:
        for i, name in enumerate(shards[:free]):
            while owner[wish[i]] is not None:
                wish[i] = (wish[i] + stride[i]) % size
            owner[wish[i]] = name
            free -= 1
            if not free:
                break
    return owner


def slot_of(key, size):
    """Slot of a key: the first 60 bits of its md5 modulo the size; a null key counts as empty."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size))


def place(docs, shards=SHARDS, size=TABLE_SIZE, key="doc_id", shard="shard", slot="slot"):
    """``docs`` with two more columns, slot and shard, named by the caller.  Nothing is shuffled.

    All rows stay, also repeated ones and rows without a key (they share the slot of the empty key).
    A column of ``docs`` that has one of the two names is replaced.
    """
    table = docs.sparkSession.createDataFrame(list(enumerate(lookup_table(list(shards), size))), f"`{slot}` long, `{shard}` string")
    placed = docs.drop(slot, shard).withColumn(slot, slot_of(F.col(key), size))
    return placed.join(F.broadcast(table), slot).select(*[c for c in docs.columns if c not in (slot, shard)], slot, shard)


def write_shards(docs, path, shards=SHARDS, size=TABLE_SIZE, key="doc_id", files=4):
    """Write one folder per shard; ``files`` slices of a shard are written by different tasks."""
    placed = place(docs, shards, size, key)
    placed.repartition("shard", F.pmod("slot", F.lit(files))).write.partitionBy("shard").parquet(path)


def placement_sql(shards=SHARDS, size=TABLE_SIZE):
    """The same placement of ``documents`` in SQL, over the stated table."""
    owners = ", ".join(f"'{name}'" for name in lookup_table(list(shards), size))
    fewer = ", ".join(f"'{name}'" for name in lookup_table(list(shards)[:-1], size))
    return f"""with slots as (
  select doc_id, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint % {size} as slot,
    strlen(coalesce(text, '')) as n_bytes from documents),
owners as (select [{owners}] as full_table, [{fewer}] as fewer_table)
select doc_id, n_bytes, slot, full_table[slot + 1] as shard, fewer_table[slot + 1] as shard_without_last
from slots, owners"""


def placements(docs):
    """(doc_id, n_bytes, slot, shard, shard_without_last): also where a row goes once the last shard is gone."""
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return place(place(rows), SHARDS[:-1], shard="shard_without_last").select(
        "doc_id", "n_bytes", "slot", "shard", "shard_without_last")
