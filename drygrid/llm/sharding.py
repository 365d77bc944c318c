"""Placement of rows on shards by a permutation-filled lookup table (Maglev hashing; Eisenbud et al., 2016).

Every shard prefers the slots of a prime-sized table in an order of its own: an offset and a skip from its name walk through all slots.
Shards take turns, each claiming the first free slot of its order, until the table is full. Shares differ by one slot at most, and
when a shard goes few rows of the others move. A row's shard is the table's entry at its key's hash; the table has ``SLOTS`` entries
whatever the data, so it is broadcast and placement takes constant time without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from drygrid.llm.common import row_tag

SLOTS, SHARDS = 65537, 64


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """Number of the claiming shard for every slot. ``slots`` must be prime and not below the number of shards."""
    if not names or len(set(names)) != len(names) or slots < len(names):
        raise ValueError("need distinct shard names and at least one slot for each")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    walks = []
    for name in names:
        digest = hashlib.md5(name.encode()).digest()
        walks.append([int.from_bytes(digest[:8]) % slots, int.from_bytes(digest[8:]) % (slots - 1) + 1])
    table, free = [-1] * slots, slots
    while free:
        for shard, walk in enumerate(walks):
            at, skip = walk
            while table[at] >= 0:
                at = (at + skip) % slots
            table[at], walk[0] = shard, (at + skip) % slots
            free -= 1
            if not free:
                break
    return table


def lookup(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows ``slot``, ``shard``."""
    return spark.createDataFrame([(i, names[s]) for i, s in enumerate(fill(names, slots))], "slot long, shard string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo ``slots``."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(docs: DataFrame, names: list[str], key: str = "doc_id", text: str | None = "text", slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``.

    Rows with equal keys share a shard. Rows with a NULL key are spread by their text if there is one, so they do not pile up; without
    text they share the slot of the empty key. Columns ``slot`` and ``shard`` of ``docs`` are replaced; empty tables give no rows.
    """
    rest = row_tag(text).cast("string") if text else F.lit("")
    keyed = docs.drop("slot", "shard").withColumn("slot", slot_of(F.coalesce(F.col(key).cast("string"), rest), slots))
    return keyed.join(F.broadcast(lookup(docs.sparkSession, names, slots)), "slot").select(*[c for c in keyed.columns if c != "slot"], "slot", "shard")


def write_shards(placed: DataFrame, path: str, files: int = 8) -> None:
    """Write one folder per shard, each in up to ``files`` files dealt by slot."""
    placed.repartition("shard", F.pmod("slot", F.lit(files))).write.partitionBy("shard").parquet(path)


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(count)]


def op3(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return place(docs, shard_names()).select("doc_id", "slot", "shard")
