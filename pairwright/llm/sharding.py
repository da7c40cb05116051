"""Sharding by virtual slots and a versioned slot-to-shard map.

A record is hashed by its id into one of a few thousand slots, for good. Bytes and rows are added up
per slot, and a map says which shard each slot belongs to. Balancing or growing edits the latest map
and stores it as the next version; records are never hashed anew, and are placed by the latest
version. The map has one row per slot, so it is bounded by the number of slots whatever the number of
records, and is made on the driver.

Places in a shard are numbered slot by slot, and in a slot part by part: a record's part is a hash of
its id and text, so a slot of any size spreads over ``PARTS`` tasks.

Defined results: a NULL text has no bytes; a record without an id is hashed by its text (NULL: the
empty text); repeated rows are records of their own and share a slot; an empty table gives no rows;
columns named like a result column are replaced, other columns are kept.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.frames import fresh, put
from pairwright.session import materialize, new_dir

#: Slots; the hash of a record never changes unless this does.
SLOTS = 4096
#: Parts of a slot that are numbered apart.
PARTS = 16


@dataclass(frozen=True)
class Load:
    slot: int
    bytes: int
    rows: int


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a record and one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    name = F.coalesce(key.cast("string"), text, F.lit(""))
    return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % slots).cast("int")


def part_loads(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS
) -> DataFrame:
    """Bytes and rows of every part of a slot that has any: at most ``slots`` times ``PARTS`` rows."""
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return (
        docs.select(
            slot_of(key, text, slots).alias("slot"),
            part_of(key, text).alias("part"),
            size_of(text).alias("bytes"),
        )
        .groupBy("slot", "part")
        .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    )


def part_of(key: Column, text: Column) -> Column:
    return F.pmod(F.xxhash64(key, text), F.lit(PARTS)).cast("int")


def slot_loads(parts: DataFrame) -> list[Load]:
    """Bytes and rows of every slot that has any: at most one row a slot."""
    found = parts.groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return [Load(r.slot, r.bytes, r.rows) for r in found.collect()]


def balanced_map(loads: list[Load], shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: heaviest slot first, always to the lightest shard."""
    weight = dict.fromkeys(range(slots), 0) | {x.slot: x.bytes for x in loads}
    lightest = [(0, shard) for shard in range(shards)]
    owner = [0] * slots
    for slot in sorted(weight, key=lambda s: (-weight[s], s)):
        total, shard = heapq.heappop(lightest)
        owner[slot] = shard
        heapq.heappush(lightest, (total + weight[slot], shard))
    return owner


def grown_map(owner: list[int], loads: list[Load], shards: int) -> list[int]:
    """The map edited for more shards: slots move only into the new ones, from the heaviest."""
    weight = {x.slot: x.bytes for x in loads}
    owner = list(owner)
    before = max(owner) + 1
    held: dict[int, list[int]] = {s: [] for s in range(before)}
    for slot, shard in enumerate(owner):
        held[shard].append(slot)
    total = {s: sum(weight.get(x, 0) for x in held[s]) for s in held}
    fair = sum(total.values()) / shards
    for new in range(before, shards):
        got = 0
        while True:
            # the heaviest shard that has a slot to give; one with a single hot slot may have none
            fits: list[int] = []
            for donor in sorted(total, key=lambda s: (-total[s], s)):
                room = min(fair - got, total[donor] - got)
                fits = [x for x in held[donor] if 0 < weight.get(x, 0) <= room]
                if fits:
                    break
            if not fits:
                break
            slot = max(fits, key=lambda x: (weight[x], -x))
            held[donor].remove(slot)
            total[donor] -= weight[slot]
            owner[slot] = new
            got += weight[slot]
    return owner


def evened_map(owner: list[int], loads: list[Load], shards: int) -> list[int]:
    """The map edited for the same shards: slots move one by one from heavy shards to the lightest.

    The slot that leaves the two most alike moves, as long as that brings them nearer.
    """
    weight = {x.slot: x.bytes for x in loads}
    owner = list(owner)
    held: dict[int, set[int]] = {s: set() for s in range(shards)}
    for slot, shard in enumerate(owner):
        if weight.get(slot):
            held[shard].add(slot)
    total = {s: sum(weight[x] for x in held[s]) for s in held}
    while True:
        light = min(total, key=lambda s: (total[s], s))
        fits: list[int] = []
        # a shard of a single hot slot may be the heaviest and have nothing to give
        for heavy in sorted(total, key=lambda s: (-total[s], s)):
            apart = total[heavy] - total[light]
            fits = [x for x in held[heavy] if weight[x] < apart]
            if fits:
                break
        if not fits:
            return owner
        slot = min(fits, key=lambda x: (abs(apart - 2 * weight[x]), x))
        held[heavy].remove(slot)
        held[light].add(slot)
        total[heavy] -= weight[slot]
        total[light] += weight[slot]
        owner[slot] = light


def store_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Write one version: the shard of every slot. A version that is there is never written over."""
    frame = spark.createDataFrame(list(enumerate(owner)), "slot int, shard int")
    frame.coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("slot int, shard int").parquet(f"{path}/version={version}")


def owners_of(spark: SparkSession, path: str, version: int) -> list[int]:
    return [r.shard for r in load_map(spark, path, version).orderBy("slot").collect()]


def latest_version(spark: SparkSession, path: str) -> int:
    """The latest version that was written to its end; 0 if there is none."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    files = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(done) or []
    return max((int(x.getPath().getParent().getName().split("=")[1]) for x in found), default=0)


def rebalance(spark: SparkSession, path: str, loads: list[Load], shards: int) -> int:
    """Edit the latest map for new loads or more shards and store it as the next version.

    With more shards slots move into the new ones alone, else from heavy shards to light ones. Returns
    the latest version, which is the same as before if nothing has to move.
    """
    version = latest_version(spark, path)
    if not version:
        raise ValueError(f"no map at {path}")
    owner = owners_of(spark, path, version)
    before = max(owner) + 1
    if shards < before:
        raise ValueError(f"the map has {before} shards; they can become more, not {shards}")
    edited = (grown_map if shards > before else evened_map)(owner, loads, shards)
    if edited == owner:
        return version
    store_map(spark, path, version + 1, edited)
    return version + 1


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = SLOTS,
    path: str | None = None,
    parts: DataFrame | None = None,
) -> DataFrame:
    """Every record with its shard and its place in the shard, bytes near equal between shards.

    Adds size, text_crc32, virtual_slot, map_version, shard, slot (place in the shard, from 0). If
    ``path`` has a map, its latest version places the records; else a map for ``shards`` is made and
    stored there (default: a new folder of the session's stage folder) as version 1. ``parts`` are the
    loads of the documents if they are at hand. Records travel once, by part of a slot, to get their
    places; records equal in id and text are in one part.
    """
    spark = docs.sparkSession
    if parts is None:
        parts = materialize(part_loads(docs, id_col, text_col, slots), "slot-parts")
    loads = slot_loads(parts)
    path = path or new_dir(spark, "slot-map")
    version = latest_version(spark, path)
    if not version:
        version = 1
        store_map(spark, path, version, balanced_map(loads, shards, slots))
    owner = owners_of(spark, path, version)
    if len(owner) != slots:
        raise ValueError(f"the map at {path} has {len(owner)} slots, not {slots}")
    rows_in = {x.slot: x.rows for x in loads}
    taken = dict.fromkeys(owner, 0)
    firsts = []
    for slot, shard in enumerate(owner):
        firsts.append((slot, shard, taken[shard]))
        taken[shard] += rows_in.get(slot, 0)
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    virtual, part, place = fresh(docs, "_virtual"), fresh(docs, "_part"), fresh(docs, "_place")
    held = fresh(docs, "_owner")
    earlier = (
        Window.partitionBy("slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # at most PARTS rows a slot, so the broadcast is bounded whatever the number of records
    owners = (
        parts.withColumn("earlier", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .join(F.broadcast(spark.createDataFrame(firsts, "slot int, shard int, at long")), "slot")
        .select(
            F.col("slot").alias(virtual),
            F.col("part").alias(part),
            F.struct("shard", (F.col("at") + F.col("earlier")).alias("first")).alias(held),
        )
    )
    owned = F.col(held)
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    in_part = Window.partitionBy(virtual, part).orderBy(key, crc, F.xxhash64(text))
    placed = (
        docs.withColumns({virtual: slot_of(key, text, slots), part: part_of(key, text)})
        .withColumn(place, F.row_number().over(in_part))
        .join(F.broadcast(owners), [virtual, part])
    )
    done = put(
        placed,
        {
            "size": size_of(text),
            "text_crc32": crc,
            "virtual_slot": F.col(virtual),
            "map_version": F.lit(version),
            "shard": owned["shard"],
            "slot": owned["first"] + F.col(place) - 1,
        },
    )
    return done.drop(virtual, part, place, held)
