"""Placement of rows on shards through a permutation-filled lookup table."""

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 2039


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def number_of(text: str) -> int:
    """The first 60 bits of the MD5 of ``text``: the same number in Python, Spark and SQL."""
    return int(md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: dict, slots: int = SLOTS) -> list:
    """The shard of every slot. ``shards`` maps a shard to its weight, a positive whole number.

    Every shard prefers the slots in an order of its own, ``offset + k * skip`` modulo the prime
    ``slots``. The shards take turns by name; at its turn a shard claims, ``weight`` times, the first
    slot of its order that is still free. The table has a fixed size that does not depend on any
    data. Removing a shard leaves nearly all slots of the others where they were.
    """
    if not is_prime(slots):
        raise ValueError(f"{slots} slots: a prime is needed, so that every order visits every slot")
    if not shards or min(shards.values()) < 1:
        raise ValueError("at least one shard, each with a weight of 1 or more")
    if sum(shards.values()) > slots:
        raise ValueError("more claims in a round than slots")
    names = sorted(shards)
    start = {s: number_of(f"offset {s}") % slots for s in names}
    skip = {s: number_of(f"skip {s}") % (slots - 1) + 1 for s in names}
    asked = dict.fromkeys(names, 0)
    owner, free = [None] * slots, slots
    while free:
        for s in names:
            for _ in range(shards[s]):
                slot = (start[s] + asked[s] * skip[s]) % slots
                while free and owner[slot] is not None:
                    asked[s] += 1
                    slot = (start[s] + asked[s] * skip[s]) % slots
                if free:
                    owner[slot] = s
                    asked[s] += 1
                    free -= 1
    return owner


def slot_table(spark: SparkSession, shards: dict, slots: int = SLOTS) -> DataFrame:
    """``slot long, shard`` as a table of ``slots`` rows."""
    filled = fill(shards, slots)
    kind = "long" if isinstance(filled[0], int) else "string"
    listed = F.split(F.lit("\n".join(map(str, filled))), "\n")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "shard")).select(
        F.col("slot").cast("long"), F.col("shard").cast(kind)
    )


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key by its text; NULL has the slot of ``null key``."""
    text = F.coalesce(key.cast("string"), F.lit("null key"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots)


def place(df: DataFrame, key: str, shards: dict, slots: int = SLOTS, out: str = "shard",
          slot_out: str = "slot") -> DataFrame:
    """``df`` with the slot and the shard of every row; map-only, one look-up a row.

    Built-in functions only. The table is broadcast; its size is ``slots`` rows whatever the data.
    Equal keys meet on one shard, so a key with a third of all rows should be placed by a finer one
    (a document's id, not its source). NULL and empty keys have fixed shards of their own; repeated
    rows are all kept and meet; an empty table gives an empty one; columns of ``df`` named like the
    results are replaced, all others are kept whatever their names.
    """
    lookup = slot_table(df.sparkSession, shards, slots).toDF("_slot", "_shard")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out, slot_out)]
    slot = slot_of(F.col(f"`{key}`"), slots)
    placed = df.select(F.struct(*kept).alias("_row"), slot.alias("_at"))
    joined = placed.join(F.broadcast(lookup), F.col("_at") == F.col("_slot"), "left")
    return joined.select("_row.*", F.col("_at").alias(slot_out), F.col("_shard").alias(out))
