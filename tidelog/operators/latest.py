"""Latest-wins state over a mutation log: snapshots, lookups, overlays, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidelog import schema as S
from tidelog.functions.scalars import expired, has_prefix

FIELDS = ("opcode", "value", "sequence", "expire_at_ns")


def latest(log: DataFrame, *more: str) -> DataFrame:
    """The row of the highest sequence per key, of any opcode.

    One partial and one final hash aggregate: a key that holds a third of the log is reduced on the map side. Filters on the key
    go below it, all others stay above, so an erased or expired version never uncovers an older one.
    """
    best = F.max_by(F.struct(*FIELDS, *more), F.col("sequence")).alias("l")
    return log.groupBy("key").agg(best).select("key", "l.*")


def index(log: DataFrame, *more: str) -> DataFrame:
    """Keys whose latest version is a put, unread-expired ones included."""
    return latest(log, *more).where(F.col("opcode") == S.PUT)


def live(log: DataFrame, now_ns: int, *more: str) -> DataFrame:
    """The visible state at a clock."""
    return index(log, *more).where(~expired(F.col("expire_at_ns"), now_ns)).drop("opcode")


def as_of(log: DataFrame, sequence: int, now_ns: int = 0) -> DataFrame:
    """The state a reader pinned at ``sequence`` sees."""
    return live(log.where(F.col("sequence") <= sequence), now_ns)


def multi_get(log: DataFrame, probes: DataFrame, now_ns: int) -> DataFrame:
    """``(pos, key, status, value, sequence)`` for each probe ``(pos, key)``, misses reported. Only probed keys are aggregated."""
    wanted = log.join(probes.select("key").distinct(), "key", "left_semi")
    found = live(wanted, now_ns)
    out = probes.join(found, "key", "left")
    return out.select("pos", "key", F.when(F.col("sequence").isNull(), "not_found").otherwise("ok").alias("status"), "value", "sequence")


def prefix_scan(log: DataFrame, prefix: str, now_ns: int) -> DataFrame:
    return live(log.where(has_prefix(F.col("key"), F.lit(prefix))), now_ns)


def rebuild_stats(log: DataFrame, now_ns: int) -> DataFrame:
    """One row: all records, then each key counted once as tombstone, expired or visible."""
    per_key = log.groupBy("key").agg(F.count("*").alias("n"), F.max_by(F.struct("opcode", "expire_at_ns"), "sequence").alias("l"))
    erased = F.col("l.opcode") == S.ERASE
    old = ~erased & expired(F.col("l.expire_at_ns"), now_ns)
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records_scanned"), F.count_if(erased).alias("tombstones"), F.count_if(old).alias("expired"), F.count_if(~erased & ~old).alias("visible"),
    )


def overlay(base: DataFrame, delta: DataFrame) -> DataFrame:
    """A base state seen through later mutations: the delta's latest hides the base, its erases hide without a value."""
    top = latest(delta)
    rest = base.join(top.select("key"), "key", "left_anti")
    return rest.unionByName(top.where(F.col("opcode") == S.PUT).drop("opcode"))


def versions(log: DataFrame) -> DataFrame:
    """``valid_to``: the sequence that supersedes each version; null for the current one."""
    return log.withColumn("valid_to", F.lead("sequence").over(W.Window.partitionBy("key").orderBy("sequence")))


def erase_outcomes(log: DataFrame) -> DataFrame:
    """Each erase hits if the version before it is a put; presence ignores expiry, which is only applied on reads."""
    before = F.lag("opcode").over(W.Window.partitionBy("key").orderBy("sequence"))
    out = log.withColumn("before", before).where(F.col("opcode") == S.ERASE)
    return out.select("key", "sequence", F.when(F.col("before") == S.PUT, "erased").otherwise("not_found").alias("status"))


def asof_reads(log: DataFrame, reads: DataFrame) -> DataFrame:
    """What each read ``(read_id, key, at_sequence, now_ns)`` sees: the last mutation of its key at or before its position.

    One union and one running window per key instead of a range join.
    """
    m = log.select("key", F.col("sequence").alias("at"), F.lit(0).alias("kind"), F.struct("opcode", "value", "expire_at_ns", "sequence").alias("m"), F.lit(None).cast("long").alias("read_id"), F.lit(None).cast("long").alias("now_ns"))
    r = reads.select("key", F.col("at_sequence").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(m.schema["m"].dataType).alias("m"), "read_id", "now_ns")
    w = W.Window.partitionBy("key").orderBy("at", "kind").rowsBetween(W.Window.unboundedPreceding, 0)
    seen = m.unionByName(r).withColumn("s", F.last("m", ignorenulls=True).over(w)).where("kind = 1")
    gone = F.col("s").isNull() | (F.col("s.opcode") == S.ERASE) | ((F.col("s.expire_at_ns") != 0) & (F.col("now_ns") != 0) & (F.col("s.expire_at_ns") <= F.col("now_ns")))
    return seen.select("read_id", "key", F.when(~gone, F.col("s.value")).alias("value"), F.when(~gone, F.col("s.sequence")).alias("sequence"), F.when(gone, "not_found").otherwise("ok").alias("status"))


def duplicate_sequences(log: DataFrame) -> DataFrame:
    """Key and sequence pairs that occur more than once, old ones too (stricter than a check of the current highest)."""
    return log.groupBy("key", "sequence").agg(F.count("*").alias("copies")).where("copies > 1")


def same_state(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Keys on which two states differ, with what each lacks."""
    x = a.select("key", F.struct(*columns).alias("x"))
    y = b.select("key", F.struct(*columns).alias("y"))
    out = x.join(y, "key", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return out.select("key", F.when(F.col("x").isNull(), "extra").when(F.col("y").isNull(), "missing").otherwise("mismatch").alias("problem"))

