"""Integrity audits: each returns the rows that violate a rule, or one row per object with its verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidelog import schema as S
from tidelog.functions.hashing import fnv1a_hex, remainder

# Names of the entries of a store directory.
MANIFEST, LOCK, MANIFEST_TMP, INTENT, COMPACTION_TMP = "manifest", ".store.lock", ".manifest.tmp", ".compaction.intent", ".compaction.tmp"
SUFFIX = ".seg"


def sequence_monotonic(placed_log: DataFrame) -> DataFrame:
    """Records whose sequence is not above the one before them in their segment."""
    before = F.lag("sequence").over(W.Window.partitionBy("segment_id").orderBy("offset"))
    return placed_log.withColumn("before", before).where("before >= sequence").select("segment_id", "offset", "sequence", "before")


def segment_overlap(stats: DataFrame) -> DataFrame:
    """Segments of a shard whose sequences start at or below the end of an earlier segment."""
    w = W.Window.partitionBy("shard").orderBy("segment_id").rowsBetween(W.Window.unboundedPreceding, -1)
    return stats.withColumn("reached", F.max("last_sequence").over(w)).where("reached >= first_sequence").select("shard", "segment_id", "first_sequence", "reached")


def wrong_owner(log: DataFrame, shards: int) -> DataFrame:
    return log.withColumn("owner", remainder(fnv1a_hex("key"), shards)).where("owner <> shard").select("key", "sequence", "shard", "owner")


def hash_mismatch(log: DataFrame) -> DataFrame:
    return log.withColumn("actual", fnv1a_hex("key")).where("actual <> key_hash").select("key", "sequence", "key_hash", "actual")


def record_validity(records: DataFrame) -> DataFrame:
    """The first rule each record ``(record_id, magic, opcode, value_type, key_bytes, value_bytes, size, offset)`` breaks, or ok."""
    need = F.floor((S.RECORD_HEADER_BYTES + F.col("key_bytes") + F.col("value_bytes") + 7) / 8) * 8
    verdict = (
        F.when(F.col("magic") != 1, "bad_magic").when(~F.col("opcode").isin(S.PUT, S.ERASE), "bad_opcode").when(~F.col("value_type").between(1, 4), "bad_type")
        .when((F.col("opcode") == S.ERASE) & (F.col("value_bytes") != 0), "erase_with_value").when(F.col("size") > S.MAX_RECORD_BYTES, "too_large")
        .when(F.pmod("offset", F.lit(8)) != 0, "misaligned").when(F.col("size") != need, "bad_size").otherwise("ok")
    )
    return records.select("record_id", verdict.alias("verdict"))


def committed_scan(placed_log: DataFrame, slots: DataFrame) -> DataFrame:
    """Per segment: the records before the committed end, their order, and whether they match the slot ``(segment_id, committed_end, record_count, first, last)``."""
    w = W.Window.partitionBy("segment_id").orderBy("offset")
    df = placed_log.join(slots, "segment_id").where("offset < committed_end").withColumn("before", F.lag("sequence").over(w))
    out = df.groupBy("segment_id").agg(
        F.count("*").alias("scanned"), F.min("sequence").alias("first_seen"), F.max("sequence").alias("last_seen"), F.count_if(F.col("before") >= F.col("sequence")).alias("disorder"),
        F.first("slot_count").alias("slot_count"), F.first("slot_first").alias("slot_first"), F.first("slot_last").alias("slot_last"), F.max(F.col("offset") + F.col("size")).alias("end"), F.first("committed_end").alias("committed_end"),
    )
    ok = (F.col("disorder") == 0) & (F.col("scanned") == F.col("slot_count")) & (F.col("first_seen") == F.col("slot_first")) & (F.col("last_seen") == F.col("slot_last")) & (F.col("end") == F.col("committed_end"))
    return out.select("segment_id", "scanned", "first_seen", "last_seen", ok.alias("matches"))


def newest(rows: DataFrame, by: list[str], generation: str, content: list[str]) -> DataFrame:
    """The row of the highest generation of each group; equal generations of unlike content conflict."""
    top = rows.groupBy(*by).agg(F.max(generation).alias(generation))
    best = rows.join(top, [*by, generation]).groupBy(*by, generation)
    return best.agg(F.countDistinct(F.struct(*content)).alias("variants"), *(F.min(c).alias(c) for c in content)).select(
        *by, generation, F.when(F.col("variants") > 1, "conflict").otherwise("ok").alias("status"), *(F.when(F.col("variants") == 1, F.col(c)).alias(c) for c in content)
    )


def commit_slot_validity(slots: DataFrame) -> DataFrame:
    """empty, valid or invalid for each slot ``(segment_id, slot_index, commit_generation, committed_end, record_count, first_sequence, last_sequence, checksum_ok)``."""
    blank = (F.col("commit_generation") == 0) & (F.col("committed_end") == 0) & (F.col("record_count") == 0)
    none = (F.col("record_count") == 0) & (F.col("committed_end") == S.SEGMENT_HEADER_BYTES) & (F.col("first_sequence") == 0) & (F.col("last_sequence") == 0)
    some = (F.col("record_count") > 0) & (F.col("committed_end") > S.SEGMENT_HEADER_BYTES) & (F.col("first_sequence") > 0) & (F.col("first_sequence") <= F.col("last_sequence"))
    fits = (F.col("committed_end") <= S.SEGMENT_BYTES) & (F.pmod("committed_end", F.lit(8)) == 0)
    verdict = F.when(blank, "empty").when(F.col("checksum_ok") & (F.col("commit_generation") > 0) & fits & (none | some), "valid").otherwise("invalid")
    return slots.select("segment_id", "slot_index", verdict.alias("validity"))


def manifest_invariants(entries: DataFrame, workers: int) -> DataFrame:
    """Problems of a catalog ``(position, segment_id, generation, owner, role)``: order, owners, one active segment per worker."""
    before = F.lag("segment_id").over(W.Window.orderBy("position"))  # a catalog is small: at most 64 Ki entries
    order = entries.withColumn("before", before).where("before >= segment_id").select(F.lit("ids_not_increasing").alias("problem"), F.col("segment_id").alias("subject"))
    owner = entries.where((F.col("owner") < 0) | (F.col("owner") >= workers)).select(F.lit("owner_out_of_range").alias("problem"), F.col("segment_id").alias("subject"))
    zero = entries.where("segment_id <= 0 OR generation <= 0").select(F.lit("zero_identity").alias("problem"), F.col("segment_id").alias("subject"))
    active = entries.groupBy("owner").agg(F.count_if(F.col("role") == "active").alias("n"))
    all_ = entries.sparkSession.range(workers).select(F.col("id").cast("int").alias("owner")).join(active, "owner", "left")
    one = all_.where("coalesce(n, 0) <> 1").select(F.lit("active_count").alias("problem"), F.col("owner").cast("long").alias("subject"))
    return order.unionByName(owner).unionByName(zero).unionByName(one)


def namespace_audit(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(name, kind)`` for each anomaly of a directory ``(name, private)`` against a catalog ``(segment_id, generation)``.

    A full outer join on the canonical name finds what is unlisted and what is missing.
    """
    final, temporary = rf"^segment-([0-9a-f]{{16}})-([0-9a-f]{{8}})\{SUFFIX}$", rf"^\.segment-([0-9a-f]{{16}})-([0-9a-f]{{8}})\{SUFFIX}\.tmp$"
    named = catalog.select(F.concat(F.lit("segment-"), F.lpad(F.lower(F.hex("segment_id")), 16, "0"), F.lit("-"), F.lpad(F.lower(F.hex("generation")), 8, "0"), F.lit(SUFFIX)).alias("name"), F.lit(True).alias("listed"))
    df = entries.withColumn("present", F.lit(True)).join(named, "name", "full_outer")
    n = F.col("name")
    zero = F.regexp_extract(n, r"segment-([0-9a-f]{16})-", 1) == "0" * 16
    zero = zero | (F.regexp_extract(n, rf"-([0-9a-f]{{8}})\{SUFFIX}", 1) == "0" * 8)
    segment, partial = n.rlike(final) & ~zero, n.rlike(temporary) & ~zero
    owned = n.startswith("segment-") | n.startswith(".segment-") | n.startswith("manifest") | n.startswith(".manifest") | n.startswith(".store") | n.startswith(".compaction")
    kind = (
        F.when(F.col("present").isNull(), "missing_catalog_segment").when(~F.col("private"), "unsafe_entry").when(n == MANIFEST_TMP, "stale_manifest_temporary")
        .when(n == COMPACTION_TMP, "stale_compaction_temporary").when(n == INTENT, "compaction_intent").when(n.isin(MANIFEST, LOCK), None).when(partial, "stale_segment_temporary")
        .when(segment, F.when(F.col("listed").isNull(), "unlisted_segment")).when(owned, "malformed_engine_name").otherwise("unknown_entry")
    )
    found = df.select("name", kind.alias("kind")).where("kind IS NOT NULL")
    needed = entries.sparkSession.createDataFrame([(MANIFEST,), (LOCK,)], "name string")
    return found.unionByName(needed.join(entries, "name", "left_anti").select("name", F.lit("missing_required_entry").alias("kind")))


BLOCKING = ("compaction_intent", "unlisted_segment", "malformed_engine_name", "unknown_entry", "unsafe_entry", "missing_catalog_segment", "missing_required_entry")
FAULTS = ("missing_catalog_segment", "missing_required_entry", "unsafe_entry")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues by kind, and whether the kind keeps recovery from starting."""
    return issues.groupBy("kind").agg(F.count("*").alias("issues")).withColumn("blocks_recovery", F.col("kind").isin(*BLOCKING))


def repair_split(entries: DataFrame, issues: DataFrame) -> DataFrame:
    """What a repair does with each name: copied, quarantined, or a fault that blocks the repair."""
    df = entries.select("name").join(issues, "name", "full_outer")
    return df.select("name", F.when(F.col("kind").isNull(), "copied").when(F.col("kind").isin(*FAULTS), "blocks").otherwise("quarantined").alias("action"))


def transition(current: DataFrame, following: DataFrame, worker: int) -> DataFrame:
    """Catalog entries that a compaction of one worker may not change so.

    ``(segment_id, problem)``: entries outside the worker's sealed set must stay; of the sealed set the
    earliest ids stay with generation + 1 and the rest go; nothing new appears.
    """
    mine = (F.col("owner") == worker) & (F.col("role") == "sealed")
    others = current.where(~mine).select("segment_id", "generation", "owner", "role")
    outputs = following.join(others.select("segment_id"), "segment_id", "left_anti").agg(F.count("*").alias("outputs"))
    rank = F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy("segment_id"))  # a catalog is small
    sources = current.where(mine).withColumn("rank", rank).crossJoin(F.broadcast(outputs))  # one row
    expected = sources.where("rank <= outputs").select("segment_id", (F.col("generation") + 1).alias("generation"), "owner", "role").unionByName(others)
    a, b = expected.select("segment_id", F.struct("generation", "owner", "role").alias("x")), following.select("segment_id", F.struct("generation", "owner", "role").alias("y"))
    out = a.join(b, "segment_id", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return out.select("segment_id", F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "unexpected").otherwise("changed").alias("problem"))


def interrupted(stores: DataFrame, old: DataFrame) -> DataFrame:
    """What recovery does with a compaction that was cut off, and whether a rollback that is asked for now may go on.

    ``stores(store, worker, old_generation, next_generation, outputs, authority)``: the intent found, of a worker (null: no intent), the
    generations of its catalogs, the segments it leaves, and the generation in force. ``old(store, segment_id, generation, owner,
    role, here, next_here)``: the old catalog's entries, whether each one's file and that of its next generation are there.
    Result: ``(store, verdict, rollback, retired, already_gone)``. In force is the old catalog: the outputs, if any, are retired (roll_back); the
    next one: the sources are (roll_forward); neither: corrupt, and nothing is touched. Files that are gone already are
    no error, as the step is run again after a crash.
    """
    from pyspark.sql import window as V

    mine = stores.where("worker IS NOT NULL").join(old, "store").where((F.col("owner") == F.col("worker")) & (F.col("role") == "sealed"))
    mine = mine.withColumn("rank", F.row_number().over(V.Window.partitionBy("store").orderBy("segment_id")))
    back, forward = F.col("authority") == F.col("old_generation"), F.col("authority") == F.col("next_generation")
    obsolete = F.when(back, F.col("rank") <= F.col("outputs")).when(forward, True).otherwise(False)
    there = F.when(back, F.col("next_here")).otherwise(F.col("here"))
    sums = mine.groupBy("store").agg(F.count_if(obsolete & there).alias("retired"), F.count_if(obsolete & ~there).alias("already_gone"))
    verdict = F.when(F.col("worker").isNull(), "nothing_to_do").when(back, "roll_back").when(forward, "roll_forward").otherwise("corrupted_data")
    zero = F.lit(0).cast("long")
    return stores.join(sums, "store", "left").select(
        "store", verdict.alias("verdict"), F.when(F.col("worker").isNull(), "nothing_to_do").when(back, "ok").otherwise("sequence_conflict").alias("rollback"),
        F.coalesce("retired", zero).alias("retired"), F.coalesce("already_gone", zero).alias("already_gone"),
    )


def backup_verify(source: DataFrame, copy: DataFrame, columns: list[str]) -> DataFrame:
    """One row: counts, an order-free checksum of each side, and whether they agree."""
    def side(df, p):
        return df.agg(F.count("*").alias(f"{p}_rows"), F.coalesce(F.sum(F.crc32(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)).cast("binary"))), F.lit(0)).alias(f"{p}_sum"))
    both = side(source, "source").crossJoin(side(copy, "copy"))  # one row each
    return both.withColumn("equal", (F.col("source_rows") == F.col("copy_rows")) & (F.col("source_sum") == F.col("copy_sum")))
