"""Physical layout: packing a log into segments, liveness, vacuum, whole-shard compaction.

A placed log has ``shard, segment_no, segment_id, offset, size, generation, role`` beside the log's columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidelog import schema as S
from tidelog.functions.hashing import fnv1a_hex, remainder
from tidelog.functions.scalars import basis_points, encoded_size, expired
from tidelog.operators import latest as L

#: Segment ids of a shard start at its number times this.
IDS_PER_SHARD = 1_000_000


def sharded(log: DataFrame, shards: int) -> DataFrame:
    """Adds ``key_hash`` (16 hex digits) and ``shard``. Distinct keys are hashed once; the log joins them by key."""
    keys = log.select("key").distinct().withColumn("key_hash", fnv1a_hex("key"))
    return log.join(keys.withColumn("shard", remainder(F.col("key_hash"), shards)), "key")


def placed(log: DataFrame, capacity: int) -> DataFrame:
    """Next-fit packing of each shard in sequence order: a record that does not fit opens the next segment.

    The running total restarts at an overflow, which no window frame expresses, so sorted partitions
    stream through a fold that keeps two numbers; memory does not grow with a shard.
    """
    payload = capacity - S.SEGMENT_HEADER_BYTES
    df = log.withColumn("size", encoded_size(F.col("key"), F.col("value")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def fold(frames):
        shard, segment, used = None, 0, 0
        for f in frames:
            segments, offsets = [], []
            for s, n in zip(f["shard"].to_numpy(), f["size"].to_numpy(), strict=True):
                if s != shard:
                    shard, segment, used = s, 0, 0
                elif used + n > payload:
                    segment, used = segment + 1, 0
                segments.append(segment)
                offsets.append(S.SEGMENT_HEADER_BYTES + used)
                used += int(n)
            yield f.assign(segment_no=pd.array(segments, "int64"), offset=pd.array(offsets, "int64"))

    packed = df.repartition("shard").sortWithinPartitions("shard", "sequence").mapInPandas(fold, f"{fields}, segment_no long, offset long")
    last = F.max("segment_no").over(W.Window.partitionBy("shard"))
    return packed.select(
        "*", (F.col("shard") * IDS_PER_SHARD + F.col("segment_no") + 1).cast("long").alias("segment_id"), F.lit(1).alias("generation"),
        F.when(F.col("segment_no") == last, "active").otherwise("sealed").alias("role"),
    )


def refs(placed_log: DataFrame) -> DataFrame:
    """The index: latest puts with their physical reference."""
    return L.index(placed_log, "shard", "segment_id", "offset", "size", "generation", "role")


def segment_stats(placed_log: DataFrame) -> DataFrame:
    """One row per segment: used bytes with the header, live bytes and records, first and last sequence."""
    live = refs(placed_log).select("segment_id", "offset", F.lit(1).alias("is_live"))
    df = placed_log.join(live, ["segment_id", "offset"], "left")
    on = F.col("is_live").isNotNull()
    return df.groupBy("shard", "segment_id", "role").agg(
        (S.SEGMENT_HEADER_BYTES + F.sum("size")).alias("used_bytes"), F.sum(F.when(on, F.col("size")).otherwise(0)).alias("live_bytes"), F.count("*").alias("record_count"),
        F.count_if(on).alias("live_records"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"),
    )


def shadowing(placed_log: DataFrame) -> DataFrame:
    """Segments holding an erase that still hides an older put of its key in another segment."""
    top = L.latest(placed_log, "segment_id").where(F.col("opcode") == S.ERASE).select("key", F.col("segment_id").alias("at"))
    older = placed_log.where(F.col("opcode") == S.PUT).join(top, "key").where("segment_id <> at")
    return older.select(F.col("at").alias("segment_id")).distinct()


def retirable(placed_log: DataFrame) -> DataFrame:
    """Sealed segments without live records whose erases hide nothing elsewhere."""
    s = segment_stats(placed_log).where("role = 'sealed' AND live_records = 0")
    return s.join(shadowing(placed_log), "segment_id", "left_anti").select("shard", "segment_id", "record_count")


def shard_live_bytes(placed_log: DataFrame) -> DataFrame:
    return refs(placed_log).groupBy("shard", "role").agg(F.sum("size").alias("live_bytes"), F.count("*").alias("keys"))


def dead_bytes(placed_log: DataFrame) -> DataFrame:
    """Per shard, over sealed segments: record bytes, live, dead and the dead ratio in basis points; all dead without sealed bytes."""
    s = segment_stats(placed_log)
    sealed = F.col("role") == "sealed"
    out = s.groupBy("shard").agg(F.sum(F.when(sealed, F.col("used_bytes") - S.SEGMENT_HEADER_BYTES).otherwise(0)).alias("sealed_bytes"), F.sum(F.when(sealed, F.col("live_bytes")).otherwise(0)).alias("live_bytes"))
    dead = F.col("sealed_bytes") - F.col("live_bytes")
    return out.select("shard", "sealed_bytes", "live_bytes", dead.alias("dead_bytes"), F.when(F.col("sealed_bytes") == 0, 10000).otherwise(basis_points(dead, F.col("sealed_bytes"))).alias("dead_bp"))


def unread_expired(placed_log: DataFrame, now_ns: int) -> DataFrame:
    """Per shard, sealed records the index still names though they have expired."""
    old = refs(placed_log).where((F.col("role") == "sealed") & expired(F.col("expire_at_ns"), now_ns))
    return old.groupBy("shard").agg(F.count("*").alias("keys"), F.sum("size").alias("bytes"))


def vacuum_candidates(placed_log: DataFrame, most_ratio: float = 0.25, limit: int = 4) -> DataFrame:
    """The sparsest sealed segments, live over used bytes at most the ratio; ties by id."""
    s = segment_stats(placed_log).where("role = 'sealed' AND record_count > 0")
    s = s.withColumn("ratio", F.col("live_bytes") / F.col("used_bytes")).where(F.col("ratio") <= most_ratio)
    return s.orderBy("ratio", "segment_id").limit(limit).select("segment_id", "shard", "live_bytes", "used_bytes")


def vacuum_result(placed_log: DataFrame, now_ns: int, most_ratio: float = 0.25, limit: int = 4) -> DataFrame:
    """What a rebuild of the candidates does to each record: copied, dropped, or kept because an erase still hides something."""
    chosen = vacuum_candidates(placed_log, most_ratio, limit).select("segment_id")
    top = L.latest(placed_log, "segment_id", "offset").select("key", F.col("segment_id").alias("ls"), F.col("offset").alias("lo"), F.col("opcode").alias("lop"))
    mine = placed_log.join(F.broadcast(chosen), "segment_id")  # at most `limit` rows
    hides = shadowing(placed_log).withColumn("hides", F.lit(True))
    out = mine.join(top, "key").join(hides, "segment_id", "left")
    current = (F.col("ls") == F.col("segment_id")) & (F.col("lo") == F.col("offset"))
    action = F.when(~current, "dropped_superseded").when(F.col("opcode") == S.ERASE, F.when(F.col("hides"), "kept_tombstone").otherwise("dropped_tombstone")).when(expired(F.col("expire_at_ns"), now_ns), "dropped_expired").otherwise("copied")
    return out.withColumn("action", action).groupBy("segment_id", "action").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))


def compaction_order(placed_log: DataFrame, now_ns: int) -> DataFrame:
    """Sealed records that survive, in the order they are rewritten within a shard."""
    keep = refs(placed_log).where((F.col("role") == "sealed") & ~expired(F.col("expire_at_ns"), now_ns))
    rank = F.row_number().over(W.Window.partitionBy("shard").orderBy("sequence", "segment_id", "offset"))
    return keep.select("shard", "key", "sequence", "value", "expire_at_ns", "size", rank.cast("long").alias("position"))


def compaction_build(placed_log: DataFrame, now_ns: int, capacity: int) -> DataFrame:
    """New sealed segments of every shard. All sealed segments of a shard go at once, so an erase leaves together with all it hides."""
    keep = refs(placed_log).where((F.col("role") == "sealed") & ~expired(F.col("expire_at_ns"), now_ns))
    again = placed(keep.select("shard", "key", "sequence", "value", "expire_at_ns", "opcode"), capacity)
    return again.select("shard", "key", "sequence", F.col("segment_no").alias("output_no"), "offset", "size")


def compaction_plan(placed_log: DataFrame, now_ns: int, capacity: int) -> DataFrame:
    """Per sealed source: replaced (earliest ids, generation + 1) or removed; a shard that gains nothing is left alone."""
    sources = placed_log.where("role = 'sealed'").select("shard", "segment_id", "generation").distinct()
    outputs = compaction_build(placed_log, now_ns, capacity).groupBy("shard").agg((F.max("output_no") + 1).alias("outputs"))
    rank = F.row_number().over(W.Window.partitionBy("shard").orderBy("segment_id"))
    n = F.count("*").over(W.Window.partitionBy("shard"))
    df = sources.withColumn("rank", rank).withColumn("sources", n).join(outputs, "shard", "left").withColumn("outputs", F.coalesce("outputs", F.lit(0)))
    action = F.when(F.col("outputs") >= F.col("sources"), "no_gain").when(F.col("rank") <= F.col("outputs"), "replaced").otherwise("removed")
    return df.select("shard", "segment_id", action.alias("action"), F.when(action == "replaced", F.col("generation") + 1).otherwise(F.col("generation")).alias("generation"))


def compaction_gain(placed_log: DataFrame, now_ns: int, capacity: int) -> DataFrame:
    """Per shard: sealed sources, outputs, whether segments are saved, and the least outputs any packing needs."""
    built = compaction_build(placed_log, now_ns, capacity).groupBy("shard").agg((F.max("output_no") + 1).cast("long").alias("outputs"), F.sum("size").alias("bytes"))
    sources = placed_log.where("role = 'sealed'").groupBy("shard").agg(F.countDistinct("segment_id").alias("sources"))
    out = sources.join(built, "shard", "left").fillna(0, ["outputs", "bytes"])
    return out.select("shard", "sources", "outputs", (F.col("outputs") < F.col("sources")).alias("gains"), F.ceil(F.col("bytes") / (capacity - S.SEGMENT_HEADER_BYTES)).cast("long").alias("least_outputs"))


def compaction_estimate(placed_log: DataFrame, now_ns: int, capacity: int, most_amplification: int = 4) -> DataFrame:
    """Per shard: temporary, reclaimed, intent and peak bytes, and whether the amplification limit allows it."""
    gain = compaction_gain(placed_log, now_ns, capacity)
    total = placed_log.agg(F.countDistinct("segment_id").alias("segments"))
    df = gain.crossJoin(F.broadcast(total))  # one row
    temporary, reclaimed = F.col("outputs") * capacity, (F.col("sources") - F.col("outputs")) * capacity
    before = S.MANIFEST_HEADER_BYTES + F.col("segments") * S.MANIFEST_ENTRY_BYTES
    after = S.MANIFEST_HEADER_BYTES + (F.col("segments") - F.col("sources") + F.col("outputs")) * S.MANIFEST_ENTRY_BYTES
    intent = S.INTENT_HEADER_BYTES + before + after
    verdict = F.when(temporary == 0, "ok").when(reclaimed == 0, "no_reclaim").when(temporary > reclaimed * most_amplification, "amplification").otherwise("ok")
    return df.select("shard", temporary.alias("temporary_bytes"), reclaimed.alias("reclaimed_bytes"), intent.alias("intent_bytes"), (F.col("segments") * capacity + temporary + before + after + intent).alias("peak_bytes"), verdict.alias("verdict"))


def compaction_stats(placed_log: DataFrame, now_ns: int, capacity: int) -> DataFrame:
    """One row: records verified, copied, dropped as superseded or expired, segments before and after."""
    sealed = placed_log.where("role = 'sealed'")
    alive = refs(placed_log).where("role = 'sealed'")
    copied = alive.where(~expired(F.col("expire_at_ns"), now_ns))
    built = compaction_gain(placed_log, now_ns, capacity).agg(F.sum("sources").alias("old_segments"), F.sum("outputs").alias("new_segments"))
    parts = sealed.agg(F.count("*").alias("verified")).crossJoin(alive.agg(F.count("*").alias("a"))).crossJoin(copied.agg(F.count("*").alias("copied"))).crossJoin(built)  # one row each
    return parts.select("verified", "copied", (F.col("a") - F.col("copied")).alias("dropped_expired"), (F.col("verified") - F.col("a")).alias("dropped_superseded"), "old_segments", "new_segments")


def next_compaction_shard(placed_log: DataFrame, cursor: int, shards: int) -> DataFrame:
    """The first shard with sealed data from a cursor on, round robin."""
    sealed = placed_log.where("role = 'sealed'").select("shard").distinct()
    return sealed.agg(F.min_by("shard", F.pmod(F.col("shard") - cursor, F.lit(shards))).alias("shard"))


def live_bytes_running(placed_log: DataFrame) -> DataFrame:
    """Live bytes of each shard after each mutation: a put adds its size and takes away the version it replaces."""
    per_key = W.Window.partitionBy("key").orderBy("sequence")
    alive = F.when(F.col("opcode") == S.PUT, F.col("size")).otherwise(0)
    df = placed_log.withColumn("alive", alive).withColumn("delta", F.col("alive") - F.coalesce(F.lag("alive").over(per_key), F.lit(0)))
    run = F.sum("delta").over(W.Window.partitionBy("shard").orderBy("sequence").rowsBetween(W.Window.unboundedPreceding, 0))
    return df.select("shard", "sequence", run.alias("live_bytes"))
