"""Sharding through fixed virtual slots.

A record's slot is a hash of its doc_id, its text's checksum and size, and its
number among the rows that are equal in these, modulo a fixed number of slots: it
never changes, and neither null nor repeated ids gather in one slot. Only the
slot-to-shard map changes: a small versioned table in storage, first slot modulo
shards, then edited by moving slots from the fullest to the emptiest shard until
their bytes are near equal. A run starts from the newest stored version and adds
one where the shards are not near equal. Records are never looked at again to
rebalance: the bytes of each slot are summed once.

The map has as many rows as there are slots, whatever the input; this is the only
data that the driver holds.

Defined results: a null text has no bytes (size 8) and checksum 0; a null doc_id
hashes like a value of its own; equal rows are numbered and spread; an empty table
gives an empty result and the first map; ties between slots or shards are decided
by their numbers; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, stash

SLOTS = 4096
SHARDS = 24
OVERHEAD = 8
#: Rebalancing ends when the fullest shard is within this share of the mean.
TOLERANCE = 0.005


@dataclass
class SlotMap:
    """Versions of the slot-to-shard map; each but the first is a list of edits."""

    slots: int = SLOTS
    shards: int = SHARDS
    edits: list[dict[int, int]] = field(default_factory=list)

    @property
    def version(self) -> int:
        return len(self.edits)

    def at(self, version: int | None = None) -> list[int]:
        """The shard of every slot at a version (default: the newest)."""
        table = [slot % self.shards for slot in range(self.slots)]
        for moved in self.edits[: self.version if version is None else version]:
            for slot, shard in moved.items():
                table[slot] = shard
        return table

    def rebalance(self, bytes_of: dict[int, int], shards: int | None = None, tolerance: float = TOLERANCE) -> SlotMap:
        """A map with one more version, its shards near equal in bytes."""
        grown = SlotMap(self.slots, self.shards, [*self.edits])
        before = grown.at()
        n = shards or max([self.shards, *[s + 1 for s in before]])
        grown.edits.append(moves(before, bytes_of, n, tolerance))
        return grown

    def spread(self, bytes_of: dict[int, int], shards: int | None = None) -> float:
        """How far the fullest shard is over the emptiest, as a share of the mean."""
        table = self.at()
        load = [0] * (shards or max([self.shards, *[s + 1 for s in table]]))
        for slot, n in bytes_of.items():
            load[table[slot]] += n
        return (max(load) - min(load)) * len(load) / sum(load) if sum(load) else 0.0

    def save(self, spark: SparkSession, path: str) -> None:
        """Store the versions that ``path`` lacks, one folder of (slot, shard) each; a version there is never overwritten."""
        stored = newest_version(spark, path)
        for v in range(0 if stored is None else stored + 1, self.version + 1):
            spark.createDataFrame(list(enumerate(self.at(v))), "slot int, shard int").coalesce(1).write.mode("error").parquet(f"{path}/version={v}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The map as stored, with all its versions; None where there is none."""
        newest = newest_version(spark, path)
        if newest is None:
            return None
        rows = spark.read.option("basePath", path).parquet(path).where(F.col("version") <= newest).collect()  # slots a version
        tables: list[dict[int, int]] = [{} for _ in range(newest + 1)]
        for r in rows:
            tables[r.version][r.slot] = r.shard
        edits = [{slot: shard for slot, shard in after.items() if before[slot] != shard} for before, after in zip(tables, tables[1:], strict=False)]
        return cls(len(tables[0]), max(tables[0].values()) + 1, edits)


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The newest complete version under ``path`` (its writer's _SUCCESS file is there)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=None)


def moves(table: list[int], bytes_of: dict[int, int], shards: int, tolerance: float) -> dict[int, int]:
    """Slots to move, one at a time from the fullest to the emptiest shard, each narrowing their difference most."""
    at = [shard if shard < shards else slot % shards for slot, shard in enumerate(table)]
    held: list[set[int]] = [set() for _ in range(shards)]
    load = [0] * shards
    for slot, shard in enumerate(at):
        if bytes_of.get(slot):
            held[shard].add(slot)
            load[shard] += bytes_of[slot]
    mean = sum(load) / shards
    while True:  # each move lowers the sum of the loads' squares, so this ends
        full = max(range(shards), key=lambda s: (load[s], -s))
        low = min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[low]
        if gap <= tolerance * mean:
            break
        slot = min((s for s in held[full] if bytes_of[s] < gap), key=lambda s: (abs(2 * bytes_of[s] - gap), s), default=None)
        back = None
        if slot is None or abs(2 * bytes_of[slot] - gap) > 0.5 * gap:
            # No single slot helps much: exchange two whose difference is nearest to half the gap.
            best = None
            mine, theirs = sorted(held[full], key=lambda s: (bytes_of[s], s)), sorted(held[low], key=lambda s: (bytes_of[s], s))
            j = 0
            for s in mine:
                while j < len(theirs) and 2 * (bytes_of[s] - bytes_of[theirs[j]]) > gap:
                    j += 1
                for t in theirs[max(0, j - 1) : j + 1]:
                    d = bytes_of[s] - bytes_of[t]
                    if 0 < d < gap and (best is None or abs(2 * d - gap) < best[0]):
                        best = (abs(2 * d - gap), s, t)
            if best and (slot is None or best[0] < abs(2 * bytes_of[slot] - gap)):
                _, slot, back = best
        if slot is None:
            break
        for s, a, b in ((slot, full, low), (back, low, full)):
            if s is not None:
                held[a].remove(s)
                held[b].add(s)
                load[a] -= bytes_of[s]
                load[b] += bytes_of[s]
                at[s] = b
    return {slot: shard for slot, shard in enumerate(at) if shard != table[slot]}


def size_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def slot_totals(records: DataFrame) -> DataFrame:
    """Records and bytes of every used slot: at most as many rows as there are slots."""
    return records.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy (the number of a row among equal ones) and virtual_slot."""
    crc = F.coalesce(F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), F.lit(0)).alias("text_crc32")
    # Equal rows are counted before they move, and told apart by a number afterwards.
    counted = docs.select("doc_id", size_bytes(F.col("text")).alias("size"), crc).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    return numbered(counted, "n", "copy").withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "copy"), F.lit(slots)).cast("int"))


def _constant(values: list[int]) -> Column:
    """An array literal; the planner folds it once."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None, tolerance: float = TOLERANCE) -> tuple[DataFrame, SlotMap]:
    """Every document with its shard and its place there, and the map.

    With ``map_path`` the newest map there is taken up (its number of slots holds),
    edited if its shards are not within the tolerance or their number changes, and
    stored again.
    """
    spark = docs.sparkSession
    plan = (SlotMap.load(spark, map_path) if map_path else None) or SlotMap(slots, shards)
    slots = plan.slots
    records = stash(with_slots(docs, slots), "shard-records")
    totals = {r.virtual_slot: (r.n, r.bytes) for r in slot_totals(records).collect()}  # at most ``slots`` rows
    bytes_of = {s: b for s, (_, b) in totals.items()}
    if max(plan.at()) >= shards or plan.spread(bytes_of, shards) > tolerance:
        edited = plan.rebalance(bytes_of, shards, tolerance)
        plan = edited if edited.edits[-1] else plan  # a few large records may leave nothing to better
    if map_path:
        plan.save(spark, map_path)
    table = plan.at()
    # A record's place: the records of its shard's earlier slots, then its place in its slot.
    first, filled = [0] * slots, [0] * shards
    for slot, shard in enumerate(table):
        first[slot] = filled[shard]
        filled[shard] += totals.get(slot, (0, 0))[0]
    shard_of, before = _constant(table), _constant(first)
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy"))
    placed = records.withColumn("slot", (F.get(before, F.col("virtual_slot")) + place - 1).cast("long"))
    return placed.withColumn("shard", F.get(shard_of, F.col("virtual_slot")).cast("int")).withColumn("map_version", F.lit(plan.version)), plan
