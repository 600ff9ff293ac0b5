"""Sharding by fixed virtual slots.

Records hash by key into thousands of slots whose number never changes. Bytes are aggregated per slot,
and a versioned slot-to-shard map, a table of as many rows as there are slots, is edited when loads
drift: only slots that must move change shard. The map is bounded by the slot count, so it is planned
on the driver; every version is stored, never changed, and rows are placed by the newest one as it is read back,
in one map-side lookup.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .shared import shared_dir

SLOTS = 16384
MAP_SCHEMA = T.StructType([
    T.StructField("version", T.LongType(), False), T.StructField("vslot", T.IntegerType(), False),
    T.StructField("shard", T.IntegerType(), False), T.StructField("bytes", T.LongType(), False),
])


def vslot(key: str, slots: int = SLOTS, text: str | None = None):
    """The fixed slot of a record: decided by its key and the slot count alone. Records without a key are spread by their text."""
    at = F.xxhash64(F.col(key).cast("string"))
    if text is not None:
        at = F.when(F.col(key).isNotNull(), at).otherwise(F.xxhash64(F.col(text)))
    return F.pmod(at, F.lit(slots)).cast("int")


def slot_bytes(sized: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each slot: a partial aggregate per task, at most ``slots`` rows to the driver."""
    loads = [0] * slots
    for r in sized.groupBy("vslot").agg(F.sum("size").alias("b")).collect():
        loads[r["vslot"]] = r["b"]
    return loads


def first_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalance(mapping: list[int], loads: list[int], shards: int) -> list[int]:
    """Edit a map until no move or swap of slots between the fullest and emptiest shard narrows their gap.

    Each edit moves the slot whose size is nearest to half the gap, or swaps the pair of slots whose
    difference is; ties go to the lower slot. The same input gives the same map.
    """
    mapping = list(mapping)
    totals = [0] * shards
    members: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for s, d in enumerate(mapping):
        totals[d] += loads[s]
        if loads[s]:
            members[d].append((loads[s], s))
    for m in members:
        m.sort()
    for _ in range(20 * len(mapping)):
        hi = max(range(shards), key=lambda d: (totals[d], -d))
        lo = min(range(shards), key=lambda d: (totals[d], d))
        gap = totals[hi] - totals[lo]
        if gap <= 1:
            break
        best = _best_edit(members[hi], members[lo], gap)
        if best is None:
            break
        give, take = best
        for item, a, b in ((give, hi, lo), (take, lo, hi)):
            if item is not None:
                members[a].remove(item)
                _insort(members[b], item)
                mapping[item[1]] = b
                totals[a] -= item[0]
                totals[b] += item[0]
    return mapping


def _insort(items: list, x) -> None:
    import bisect

    bisect.insort(items, x)


def _best_edit(high: list, low: list, gap: int):
    """The (slot given, slot taken or None) whose net size is nearest to gap/2 and strictly inside (0, gap)."""
    import bisect

    found, miss = None, gap
    for give in high:
        wanted = give[0] - gap / 2
        near = [None] if give[0] < gap else []
        k = bisect.bisect_left(low, (wanted,))
        near += low[max(0, k - 1) : k + 1]
        for take in near:
            net = give[0] - (take[0] if take else 0)
            if 0 < net < gap and abs(2 * net - gap) < miss:
                found, miss = (give, take), abs(2 * net - gap)
    return found


def grow(mapping: list[int], loads: list[int], shards: int) -> list[int]:
    """One more shard: slots move only into it, from the fullest shards, until it holds its share."""
    mapping = list(mapping)
    share = sum(loads) / (shards + 1)
    totals = [0] * shards
    for s, d in enumerate(mapping):
        totals[d] += loads[s]
    by = {d: sorted((s for s in range(len(mapping)) if mapping[s] == d), key=lambda s: (-loads[s], s)) for d in range(shards)}
    heap, got = [(-totals[d], d) for d in range(shards)], 0
    heapq.heapify(heap)
    while heap and got < share:
        total, d = heapq.heappop(heap)
        fit = next((s for s in by[d] if 0 < loads[s] <= share - got), None)
        if fit is None:
            continue
        by[d].remove(fit)
        mapping[fit], got = shards, got + loads[fit]
        heapq.heappush(heap, (total + loads[fit], d))
    return mapping


def map_table(spark, mapping: list[int], loads: list[int], version: int) -> DataFrame:
    """A version of the map as a table; ``save_map`` keeps all versions side by side."""
    return spark.createDataFrame([(version, s, d, loads[s]) for s, d in enumerate(mapping)], MAP_SCHEMA)


def save_map(map_df: DataFrame, path: str, version: int) -> None:
    """Store a version in a folder of its own; a version that exists is an error, so of two writers one fails."""
    map_df.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the newest by default."""
    saved = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = saved.agg(F.max("version")).first()[0] if version is None else version
    return saved.where(F.col("version") == version)


def mapping_of(map_df: DataFrame) -> list[int]:
    """The shard of each slot of one version, in slot order: as many rows as slots."""
    return [r["shard"] for r in sorted(map_df.select("vslot", "shard").collect(), key=lambda r: r["vslot"])]


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(key, size, text_crc32, vslot)``: UTF-8 bytes plus 8 for the key. Null text: no bytes, checksum 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), vslot(key, slots, text).alias("vslot"))


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard, vslot)`` for every row of ``docs``.

    Law ``bytes``: shard sizes are near equal, as the map is edited to the measured bytes per slot. The map stored
    at ``path`` is edited, its next version stored beside it and read back; where there is none (a new folder by
    default) version 1 deals slots out in turn. An edit that changes nothing makes no version. Rows without a key have a slot by their text.
    ``slot`` numbers a shard's rows without gaps from 0 in the order (vslot, key, text_crc32, size):
    ranks are counted inside a slot and shifted by the counts of the slots before it, so no task
    holds a shard. Repeated rows are rows of their own; an empty table gives no row; columns other
    than the key and the text are not read, so clashing names do no harm.
    """
    spark = docs.sparkSession
    rows = sized(docs, key, text, slots)
    stat = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most `slots` rows
    loads, counts = [0] * slots, [0] * slots
    for r in stat:
        loads[r["vslot"]], counts[r["vslot"]] = r["bytes"], r["n"]
    path = path or f"{shared_dir(spark).rstrip('/')}/maps/{uuid.uuid4().hex}"
    if not _exists(spark, path):
        save_map(map_table(spark, first_map(slots, shards), [0] * slots, 1), path, 1)
    newest = load_map(spark, path)
    old, version = mapping_of(newest), newest.first()["version"]
    if len(old) != slots or max(old) >= shards:
        raise ValueError("the stored map has other slots or more shards")
    edited = rebalance(old, loads, shards)
    if edited != old:
        save_map(map_table(spark, edited, loads, version + 1), path, version + 1)
    mapping = mapping_of(load_map(spark, path))
    before, base = [0] * slots, [0] * shards
    for s, d in enumerate(mapping):
        before[s], base[d] = base[d], base[d] + counts[s]
    plan = spark.createDataFrame([(s, mapping[s], before[s]) for s in range(slots) if counts[s]], "vslot int, shard int, before long")
    order = W.Window.partitionBy("vslot").orderBy(key, "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(F.broadcast(plan), "vslot").select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
