"""Query registry: each query reads its whole tables and applies one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import codec as K
from tidelog.functions import hashing as H
from tidelog.functions import scalars as C
from tidelog.operators import audit as A
from tidelog.operators import decisions as D
from tidelog.operators import folds as X
from tidelog.operators import latest as L
from tidelog.operators import metrics as M
from tidelog.operators import segments as G
from tidelog.sources import logs

#: Shards of the queries, bytes of a segment with its header, the sequence of pinned readers.
SHARDS, CAPACITY, PINNED = 8, 16384, 5000
SIP_SEED = 0x1111222233334444
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _log(spark: SparkSession, d: str) -> DataFrame:
    return logs.event_log(spark, d)


def _shards(spark: SparkSession, d: str) -> DataFrame:
    return G.sharded(_log(spark, d), SHARDS)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return G.placed(_shards(spark, d), CAPACITY)


def _now(spark: SparkSession, d: str) -> int:
    return logs.clock(_log(spark, d))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """One case per order; its number decides the fields of synthetic observations."""
    return logs.read(spark, d, "orders").select(F.col("o_orderkey").alias("i"))


# state

@query
def live_snapshot(spark, d):
    return L.live(_log(spark, d), _now(spark, d))


@query
def live_snapshot_parts(spark, d):
    return L.live(logs.part_log(spark, d), 0).drop("expire_at_ns")


@query
def live_snapshot_orders(spark, d):
    return L.live(logs.order_log(spark, d), 0).drop("expire_at_ns")


@query
def kv_get(spark, d):
    return L.live(_log(spark, d).where(F.col("key") == "user:7"), _now(spark, d))


@query
def kv_multi_get(spark, d):
    probes = logs.read(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("user:"), (F.col("c_custkey") * 3 % 2000).cast("string")).alias("key"))
    return L.multi_get(_log(spark, d), probes, _now(spark, d))


@query
def snapshot_as_of_seq(spark, d):
    return L.as_of(_log(spark, d), PINNED)


@query
def live_keys_sorted(spark, d):
    """Index content in byte order; the place is a column, as results have no order."""
    keys = L.index(_log(spark, d)).select("key")
    ranked = keys.orderBy("key")
    return ranked.select("key", F.octet_length("key").alias("key_bytes"))


@query
def live_entries(spark, d):
    return G.refs(_placed(spark, d)).select("key", "sequence", "segment_id", "offset", "size", "generation")


@query
def prefix_scan(spark, d):
    return L.prefix_scan(_log(spark, d), "user:1", _now(spark, d))


@query
def expired_keys(spark, d):
    return L.index(_log(spark, d)).where(C.expired(F.col("expire_at_ns"), _now(spark, d))).select("key", "sequence", "expire_at_ns")


@query
def tombstoned_keys(spark, d):
    return L.latest(_log(spark, d)).where(F.col("opcode") == S.ERASE).select("key", "sequence")


@query
def rebuild_stats(spark, d):
    return L.rebuild_stats(_log(spark, d), _now(spark, d))


@query
def overlay_get(spark, d):
    log = _log(spark, d)
    return L.overlay(L.as_of(log, PINNED), log.where(F.col("sequence") > PINNED)).select("key", "value", "sequence", "expire_at_ns")


@query
def merge_base_delta(spark, d):
    """The merged base after folding in the delta: count and a checksum by shard."""
    log = _shards(spark, d)
    merged = L.overlay(L.index(log.where(F.col("sequence") <= PINNED)).drop("opcode"), log.where(F.col("sequence") > PINNED))
    return merged.groupBy(F.pmod(F.col("sequence"), F.lit(SHARDS)).alias("part")).agg(F.count("*").alias("keys"), F.sum("sequence").alias("sequence_sum"))


@query
def version_intervals(spark, d):
    return L.versions(_log(spark, d)).select("key", "sequence", "opcode", "valid_to")


@query
def erase_outcomes(spark, d):
    return L.erase_outcomes(_log(spark, d))


@query
def asof_reads(spark, d):
    log = _log(spark, d)
    reads = log.select((F.col("sequence") * 10).alias("read_id"), F.concat(F.lit("user:"), F.pmod(F.col("user_id") * 7, F.lit(1000)).cast("string")).alias("key"), F.col("sequence").alias("at_sequence"), F.col("commit_ns").alias("now_ns"))
    return L.asof_reads(log, reads)


@query
def duplicate_sequences(spark, d):
    """Line items by part and line number, where numbers repeat."""
    li = logs.read(spark, d, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("key"), F.col("l_linenumber").cast("long").alias("sequence"))
    return L.duplicate_sequences(li)


@query
def verify_index(spark, d):
    """An index with known faults against the rebuilt one."""
    real = L.index(_log(spark, d))
    stale = real.where(F.pmod("sequence", F.lit(11)) != 0).withColumn("sequence", F.when(F.pmod("sequence", F.lit(7)) == 0, F.col("sequence") - 1).otherwise(F.col("sequence")))
    return L.same_state(real, stale, ["sequence"])


@query
def hot_cache_hits(spark, d):
    """Cached references of an earlier time that the index still names."""
    p = _placed(spark, d)
    cols = ["segment_id", "offset", "size", "generation", "sequence"]
    old, new = (G.refs(x).select("key", *cols) for x in (p.where(F.col("sequence") <= PINNED), p))
    hit = old.join(new.withColumn("hit", F.lit(True)), ["key", *cols], "left")
    return hit.select("key", "sequence", F.coalesce("hit", F.lit(False)).alias("hit"))


@query
def history_check(spark, d):
    """All events of each user as a history of overlapping operations; every get whose id 9 divides answers something else."""
    e = logs.read(spark, d, "events").select(F.col("user_id"), F.col("event_id").alias("id"), "event_type", F.col("value").cast("string").alias("v"))
    from pyspark.sql import window as W

    w = W.Window.partitionBy("user_id").orderBy("id")
    e = e.withColumn("n", F.row_number().over(w))
    kind = F.when(F.col("event_type") == "error", "erase").when(F.col("event_type") == "view", "get").otherwise("put")
    e = e.withColumn("kind", kind)
    past = F.last(F.when(F.col("kind") == "put", F.struct(F.col("v").alias("v"))).when(F.col("kind") == "erase", F.struct(F.lit(None).cast("string").alias("v"))), ignorenulls=True).over(w)
    seen = F.when(F.col("kind") == "get", F.when(F.pmod("id", F.lit(9)) == 0, F.lit("?")).otherwise(past["v"]))
    return X.history_check(e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), "id", "kind", F.col("v").alias("value"), seen.alias("seen"), (F.col("n") * 10).alias("call"), (F.col("n") * 10 + 12).alias("ret")))


# mutations

@query
def put_apply(spark, d):
    """Orders put into the event log: sequences go on after each shard's last."""
    from pyspark.sql import window as W

    last = _shards(spark, d).groupBy("shard").agg(F.max("sequence").alias("last"))
    puts = G.sharded(logs.order_log(spark, d), SHARDS)
    n = F.row_number().over(W.Window.partitionBy("shard").orderBy("sequence"))
    return puts.withColumn("n", n).join(last, "shard").select("key", "shard", (F.col("last") + F.col("n")).alias("sequence"), "value")


@query
def put_batch_status(spark, d):
    """One status per item of each customer's batch, in order; empty keys and large values are refused and spare the rest."""
    o = logs.read(spark, d, "orders")
    key = F.when(F.pmod("o_orderkey", F.lit(13)) == 0, "").otherwise(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")))
    size = F.when(F.pmod("o_orderkey", F.lit(17)) == 0, S.MAX_RECORD_BYTES).otherwise(F.octet_length("o_orderpriority"))
    items = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", key.alias("key"), size.alias("size")))).alias("items"))
    item = items.select("o_custkey", F.posexplode("items").alias("pos", "item"))
    total = S.RECORD_HEADER_BYTES + F.octet_length("item.key") + F.col("item.size")
    status = F.when(F.col("item.key") == "", "invalid_argument").when(total > S.MAX_RECORD_BYTES, "too_large").otherwise("ok")
    return item.select("o_custkey", F.col("pos").cast("long").alias("pos"), F.col("item.o_orderkey").alias("o_orderkey"), status.alias("status"))


@query
def batch_grouping(spark, d):
    """Batches of a hundred requests grouped by owner; a group whose owner is 3 fails and spares the others."""
    log = _shards(spark, d).withColumn("batch", F.floor((F.col("sequence") - 1) / 100))
    out = log.groupBy("batch", "shard").agg(F.count("*").alias("items"), F.min("sequence").alias("first"))
    return out.select("batch", "shard", "items", "first", F.when(F.col("shard") == 3, "failed").otherwise("ok").alias("status"))


@query
def record_encode(spark, d):
    """Canonical bytes of every event and their checksum."""
    r = K.encode_records(_log(spark, d))
    return r.select("sequence", F.octet_length("record").cast("long").alias("bytes"), H.crc32c_hex("record").alias("checksum"))


@query
def record_decode(spark, d):
    """Bytes of every event read back; one byte of every ninetieth is flipped first."""
    r = K.encode_records(_log(spark, d).withColumn("value", F.coalesce("value", F.lit(""))))
    x = F.hex("record")
    broken = F.unhex(F.concat(F.substring(x, 1, 100), F.when(F.substring(x, 101, 1) == "0", "1").otherwise("0"), F.substring(x, F.lit(102), F.length(x))))
    r = r.withColumn("record", F.when(F.pmod("sequence", F.lit(90)) == 0, broken).otherwise(F.col("record")))
    return K.decode_records(r).select("sequence", F.col("decoded.verdict").alias("verdict"), F.col("decoded.key").alias("key"), F.col("decoded.value").alias("value"))


@query
def wire_decode(spark, d):
    """All requests of each user as one byte stream of frames, decoded again; the last frame of a stream may be partial."""
    hx = lambda c, n: _little(c, n)
    r = _requests(spark, d)
    code = F.create_map(*(F.lit(x) for k, v in K.OPCODES.items() for x in (v, k)))[F.col("opcode")]
    target = F.when(F.col("opcode") == "bind_worker", hx(F.pmod("request_id", F.lit(SHARDS)), 4)).otherwise("FFFFFFFF")
    key, value = (F.hex(F.encode(F.coalesce(c, F.lit("")), "utf-8")) for c in ("key", "value"))
    nk, nv = F.octet_length("key"), F.coalesce(F.octet_length("value"), F.lit(0))
    frame = F.concat(hx(nk + nv + 40, 4), F.lit("0200"), hx(code, 1), F.lit("00"), hx(F.col("request_id"), 8), hx(nk, 4), hx(nv, 4), hx(F.col("expire_at_ns"), 8), target, F.lit("00000000"), key, value)
    parts = F.array_sort(F.collect_list(F.struct("request_id", frame.alias("f"))))
    streams = r.groupBy("key").agg(F.array_join(F.transform(parts, lambda x: x["f"]), "").alias("h")).select(F.substring_index("key", ":", -1).cast("long").alias("stream_id"), F.unhex("h").alias("data"))
    whole = streams.select("stream_id", F.when(F.pmod("stream_id", F.lit(3)) == 0, F.substring(F.col("data"), F.lit(1), F.octet_length("data") - 3)).otherwise(F.col("data")).alias("data"))
    return K.decode_requests(whole)


@query
def response_decode(spark, d):
    """The answer to each user's requests as one byte stream of frames, decoded again; the last frame of a stream may be partial."""
    r = _requests(spark, d).withColumn("status", F.when(F.pmod("request_id", F.lit(19)) == 0, F.pmod("request_id", F.lit(11))).otherwise(0))
    value = F.when(F.col("opcode") == "get", F.col("key")).otherwise("")
    nv = F.octet_length(value)
    frame = F.concat(_little(nv + 40, 4), F.lit("0200"), _little(F.col("status"), 2), _little(F.col("request_id"), 8), _little(nv, 4), _little(F.pmod("request_id", F.lit(SHARDS)), 4), _little(F.lit(SHARDS), 4), F.lit("00000000"), _little(F.lit(7), 8), F.hex(F.encode(value, "utf-8")))
    parts = F.array_sort(F.collect_list(F.struct("request_id", frame.alias("f"))))
    streams = r.groupBy("key").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["f"]), "")).alias("data")).select(F.substring_index("key", ":", -1).cast("long").alias("stream_id"), "data")
    return K.decode_responses(streams.select("stream_id", F.when(F.pmod("stream_id", F.lit(4)) == 0, F.substring(F.col("data"), F.lit(1), F.octet_length("data") - 3)).otherwise(F.col("data")).alias("data")))


def _little(c, n: int):
    """A whole number as n little-endian bytes in hex."""
    h = F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))))


@query
def workload_zipf(spark, d):
    """A benchmark workload as large as the event table, by worker."""
    from tidelog.sources import workloads

    n = logs.read(spark, d, "events").count()
    return workloads.operations(spark, n, 4096, SHARDS, "zipf", seed=7).groupBy("worker").agg(F.count("*").alias("operations"), F.countDistinct("key").alias("keys"))


@query
def backup_verify(spark, d):
    live = L.live(_log(spark, d), 0)
    return A.backup_verify(live, live.where(F.pmod("sequence", F.lit(101)) != 0), ["key", "sequence", "expire_at_ns"])


@query
def reshard(spark, d):
    """Live keys under another shard count."""
    live = L.live(_log(spark, d), _now(spark, d))
    keys = live.select("key").withColumn("key_hash", H.fnv1a_hex("key"))
    return live.join(keys, "key").select("key", H.remainder(F.col("key_hash"), SHARDS).alias("old_shard"), H.remainder(F.col("key_hash"), 12).alias("new_shard"))


@query
def reshard_resume(spark, d):
    """What is left to copy after the last key that was."""
    live = L.live(_log(spark, d).where(F.col("key") > "user:5"), _now(spark, d))
    return live.select("key", H.remainder(H.fnv1a_hex("key"), 12).alias("new_shard"))


# layout

@query
def segment_packing(spark, d):
    return _placed(spark, d).select("shard", "sequence", "segment_no", "offset", "size")


@query
def segment_scan(spark, d):
    """Every segment in offset order."""
    return _placed(spark, d).select("segment_id", "offset", "sequence", "opcode", "key")


@query
def committed_scan_audit(spark, d):
    return A.committed_scan(_placed(spark, d), _slots(spark, d))


def _slots(spark, d):
    """Commit slots that stop before the last record of every third segment, and misstate the count of every fifth."""
    s = G.segment_stats(_placed(spark, d))
    p = _placed(spark, d).groupBy("segment_id").agg(F.max("offset").alias("last_offset"), F.max_by(F.col("size"), "offset").alias("last_size"))
    df = s.join(p, "segment_id")
    short = (F.pmod("segment_id", F.lit(3)) == 0) & (F.col("record_count") > 1)
    wrong = F.pmod("segment_id", F.lit(5)) == 0
    return df.select(
        "segment_id", F.when(short, F.col("last_offset")).otherwise(F.col("last_offset") + F.col("last_size")).alias("committed_end"), (F.col("record_count") - short.cast("int") + wrong.cast("int")).alias("slot_count"),
        F.col("first_sequence").alias("slot_first"), F.col("last_sequence").alias("slot_last"),
    )


@query
def positional_read(spark, d):
    """References read by place; stale generations and wrong sizes are refused."""
    p = _placed(spark, d)
    ask = G.refs(p).select(F.col("key").alias("asked_key"), "segment_id", "offset", F.when(F.pmod("sequence", F.lit(7)) == 0, 2).otherwise(1).alias("asked_generation"), F.when(F.pmod("sequence", F.lit(5)) == 0, F.col("size") + 8).otherwise(F.col("size")).alias("asked_size"))
    got = p.select("segment_id", "offset", "generation", "size", "sequence")
    status = F.when(F.col("sequence").isNull(), "out_of_range").when(F.col("generation") != F.col("asked_generation"), "stale_generation").when(F.col("size") != F.col("asked_size"), "size_mismatch").otherwise("ok")
    return ask.join(got, ["segment_id", "offset"], "left").select("asked_key", "segment_id", "offset", status.alias("status"))


@query
def segment_stats(spark, d):
    return G.segment_stats(_placed(spark, d))


@query
def segment_inspect(spark, d):
    """Identity and selected slot of each segment."""
    s = G.segment_stats(_placed(spark, d)).join(_slots(spark, d).select("segment_id", "committed_end"), "segment_id")
    return s.select("segment_id", "shard", "role", "record_count", "committed_end", C.segment_filename(F.col("segment_id"), F.lit(1).cast("long"), A.SUFFIX).alias("name"))


@query
def segments_retirable(spark, d):
    return G.retirable(_placed(spark, d))


@query
def shard_live_bytes(spark, d):
    return G.shard_live_bytes(_placed(spark, d))


@query
def dead_bytes_by_shard(spark, d):
    return G.dead_bytes(_placed(spark, d))


@query
def unread_expired(spark, d):
    return G.unread_expired(_placed(spark, d), _now(spark, d))


@query
def next_sequence(spark, d):
    return _shards(spark, d).groupBy("shard").agg((F.max("sequence") + 1).alias("next_sequence"))


@query
def shard_histogram(spark, d):
    return _shards(spark, d).groupBy("shard").agg(F.count("*").alias("records"), F.countDistinct("key").alias("keys"))


@query
def live_bytes_running(spark, d):
    return G.live_bytes_running(_placed(spark, d))


@query
def vacuum_candidates(spark, d):
    return G.vacuum_candidates(_placed(spark, d), 0.25, 4)


@query
def vacuum_result(spark, d):
    return G.vacuum_result(_placed(spark, d), _now(spark, d))


@query
def compaction_order(spark, d):
    return G.compaction_order(_placed(spark, d), _now(spark, d)).select("shard", "key", "sequence", "position")


@query
def compaction_build(spark, d):
    return G.compaction_build(_placed(spark, d), _now(spark, d), CAPACITY)


@query
def compaction_plan(spark, d):
    return G.compaction_plan(_placed(spark, d), _now(spark, d), CAPACITY)


@query
def compaction_gain(spark, d):
    return G.compaction_gain(_placed(spark, d), _now(spark, d), CAPACITY).drop("least_outputs")


@query
def packing_lower_bound(spark, d):
    return G.compaction_gain(_placed(spark, d), _now(spark, d), CAPACITY).select("shard", "outputs", "least_outputs")


@query
def compaction_estimate(spark, d):
    return G.compaction_estimate(_placed(spark, d), _now(spark, d), CAPACITY)


@query
def compaction_stats(spark, d):
    return G.compaction_stats(_placed(spark, d), _now(spark, d), CAPACITY)


@query
def next_compaction_shard(spark, d):
    return G.next_compaction_shard(_placed(spark, d).where("shard NOT IN (5, 6)"), 5, SHARDS)


def _catalogs(spark, d):
    """The catalog before, and one after a compaction of worker 2 with two faults."""
    p = _placed(spark, d).select("segment_id", "generation", F.col("shard").alias("owner"), "role").distinct()
    first = F.min(F.when((F.col("owner") == 2) & (F.col("role") == "sealed"), F.col("segment_id"))).alias("first")
    edge = p.agg(first)
    after = p.crossJoin(F.broadcast(edge)).where("NOT (owner = 2 AND role = 'sealed' AND segment_id > first + 1)")  # one row
    done = after.withColumn("generation", F.when(F.col("segment_id") == F.col("first"), F.col("generation") + 1).when((F.col("owner") == 4) & (F.col("role") == "active"), F.col("generation") + 5).otherwise(F.col("generation")))
    return p, done.drop("first")


@query
def compaction_transition(spark, d):
    return A.transition(*_catalogs(spark, d), worker=2)


@query
def compaction_recovery(spark, d):
    """Each customer's orders as the sealed segments of a store whose compaction was cut off somewhere."""
    o = logs.read(spark, d, "orders").select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("segment_id"))
    i, s = F.col("segment_id"), F.col("store")
    old = o.select("store", "segment_id", F.lit(1).alias("generation"), F.pmod(i, F.lit(2)).alias("owner"), F.lit("sealed").alias("role"), (F.pmod(i, F.lit(11)) != 0).alias("here"), (F.pmod(i, F.lit(5)) != 0).alias("next_here"))
    worker, authority = F.when(F.pmod(s, F.lit(5)) != 0, F.pmod(s, F.lit(2))), F.when(F.pmod(s, F.lit(7)) == 0, 12).when(F.pmod(s, F.lit(3)) == 0, 9).otherwise(10)
    stores = o.groupBy("store").agg(F.floor(F.count("*") / 4).alias("outputs")).select("store", worker.alias("worker"), F.lit(9).alias("old_generation"), F.lit(10).alias("next_generation"), "outputs", authority.alias("authority"))
    return A.interrupted(stores, old)


@query
def manifest_encode(spark, d):
    """Each shard's segments as a catalog's bytes and back."""
    return K.catalogs_round_trip(_placed(spark, d).select("shard", "segment_id", "generation", "role"))


@query
def segment_header_encode(spark, d):
    """Each segment's header with its commits as bytes and back."""
    s = G.segment_stats(_placed(spark, d))
    return K.headers_round_trip(s.select("segment_id", "shard", F.lit(1).alias("generation"), F.col("used_bytes").alias("committed_end"), (F.col("role") == "sealed").alias("sealed"), "record_count", "first_sequence", "last_sequence"))


@query
def entry_catalog_join(spark, d):
    """Index entries whose segment a catalog without every fourth segment does not list."""
    p = _placed(spark, d)
    listed = p.select("segment_id").distinct().where("segment_id % 4 <> 0")
    return G.refs(p).join(listed, "segment_id", "left_anti").select("key", "segment_id", "sequence")


# audits

@query
def sequence_monotonic(spark, d):
    """The log read as if sequences of every fiftieth record were lower."""
    p = _placed(spark, d).withColumn("sequence", F.when(F.pmod("sequence", F.lit(50)) == 0, F.col("sequence") - 40).otherwise(F.col("sequence")))
    return A.sequence_monotonic(p)


@query
def segment_overlap(spark, d):
    s = G.segment_stats(_placed(spark, d)).withColumn("last_sequence", F.when(F.pmod("segment_id", F.lit(4)) == 1, F.col("last_sequence") + 100).otherwise(F.col("last_sequence")))
    return A.segment_overlap(s)


@query
def wrong_owner(spark, d):
    s = _shards(spark, d).withColumn("shard", F.when(F.pmod("sequence", F.lit(97)) == 0, F.pmod(F.col("shard") + 1, F.lit(SHARDS))).otherwise(F.col("shard")).cast("int"))
    return A.wrong_owner(s, SHARDS)


@query
def hash_mismatch(spark, d):
    s = _shards(spark, d).withColumn("key_hash", F.when(F.pmod("sequence", F.lit(89)) == 0, F.reverse("key_hash")).otherwise(F.col("key_hash")))
    return A.hash_mismatch(s)


@query
def record_validity(spark, d):
    i = F.col("i")
    k, v = F.pmod(i, F.lit(40)) + 1, F.when(F.pmod(i, F.lit(4)) == 1, 0).otherwise(F.pmod(i * 7, F.lit(300)))
    size = F.floor((S.RECORD_HEADER_BYTES + k + v + 7) / 8) * 8
    df = _cases(spark, d).select(
        i.alias("record_id"), F.when(F.pmod(i, F.lit(31)) == 0, 0).otherwise(1).alias("magic"), F.when(F.pmod(i, F.lit(29)) == 0, 3).otherwise(F.when(F.pmod(i, F.lit(4)) == 1, S.ERASE).when(F.pmod(i, F.lit(37)) == 0, S.ERASE).otherwise(S.PUT)).alias("opcode"),
        F.pmod(i, F.lit(5)).alias("value_type"), k.alias("key_bytes"), v.alias("value_bytes"), F.when(F.pmod(i, F.lit(23)) == 0, size + 8).when(F.pmod(i, F.lit(41)) == 0, S.MAX_RECORD_BYTES + 8).otherwise(size).alias("size"),
        F.when(F.pmod(i, F.lit(19)) == 0, 4100).otherwise(4096).alias("offset"),
    )
    return A.record_validity(df)


def _slot_pairs(spark, d):
    """Two commit slots for each order number."""
    i = F.col("i")
    base = _cases(spark, d).select(i.alias("segment_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("slot_index"))
    s, x = F.col("segment_id"), F.col("slot_index")
    blank = (F.pmod(s, F.lit(11)) == 0) & (x == 1)
    gen = F.when(blank, 0).when(F.pmod(s, F.lit(13)) == 0, 7).otherwise(F.pmod(s * 3, F.lit(50)) + x + 1)
    n = F.when(blank, 0).otherwise(F.pmod(s, F.lit(9)) + x)
    end = F.when(blank, 0).when(F.pmod(s, F.lit(17)) == 0, 4100).otherwise(4096 + n * 96)
    return base.select(
        "segment_id", "slot_index", gen.alias("commit_generation"), end.alias("committed_end"), n.alias("record_count"), F.when(n > 0, s + 1).otherwise(0).alias("first_sequence"), F.when(n > 0, s + n).otherwise(0).alias("last_sequence"),
        (F.pmod(s + x, F.lit(19)) != 0).alias("checksum_ok"),
    )


@query
def commit_slot_validity(spark, d):
    return A.commit_slot_validity(_slot_pairs(spark, d))


@query
def commit_slot_newest(spark, d):
    slots = _slot_pairs(spark, d)
    good = slots.join(A.commit_slot_validity(slots).where("validity = 'valid'"), ["segment_id", "slot_index"], "left_semi")
    return A.newest(good, ["segment_id"], "commit_generation", ["committed_end", "record_count", "last_sequence"])


@query
def manifest_newest(spark, d):
    """Versions of a catalog per clerk of customers; some equal generations differ."""
    o = logs.read(spark, d, "orders").select(F.pmod("o_custkey", F.lit(50)).alias("store"), F.pmod("o_orderkey", F.lit(400)).alias("manifest_generation"), F.when(F.pmod("o_orderkey", F.lit(3)) == 0, 8).otherwise(4).alias("worker_count"))
    return A.newest(o, ["store"], "manifest_generation", ["worker_count"])


@query
def manifest_invariants(spark, d):
    p = _placed(spark, d).select("segment_id", "generation", F.col("shard").alias("owner"), "role").distinct()
    broken = p.withColumn("position", F.when(F.pmod("segment_id", F.lit(7)) == 3, F.col("segment_id") - 2.5).otherwise(F.col("segment_id") * 1.0)).withColumn("owner", F.when(F.pmod("segment_id", F.lit(9)) == 4, 99).otherwise(F.col("owner")))
    return A.manifest_invariants(broken.withColumn("role", F.when(F.col("owner") == 1, "sealed").otherwise(F.col("role"))), SHARDS)


def _directory(spark, d):
    """A directory listing made from parts, and the catalog it is held against."""
    i = F.col("p_partkey")
    hx = F.concat(F.lit("segment-"), F.lpad(F.lower(F.hex(i)), 16, "0"), F.lit("-"), F.lpad(F.lower(F.hex(F.pmod(i, F.lit(3)))), 8, "0"))
    name = (
        F.when(F.pmod(i, F.lit(23)) == 0, F.concat(F.lit("."), hx, F.lit(A.SUFFIX + ".tmp"))).when(F.pmod(i, F.lit(29)) == 0, F.concat(F.lit("notes-"), i.cast("string"), F.lit(".txt")))
        .when(F.pmod(i, F.lit(31)) == 0, F.concat(F.lit("segment-"), i.cast("string"))).when(i == 5, A.MANIFEST).when(i == 7, A.MANIFEST_TMP).when(i == 8, A.INTENT).when(i == 10, A.COMPACTION_TMP).otherwise(F.concat(hx, F.lit(A.SUFFIX)))
    )
    part = logs.read(spark, d, "part")
    entries = part.where(F.pmod(i, F.lit(37)) != 0).select(name.alias("name"), (F.pmod(i, F.lit(41)) != 0).alias("private"))
    catalog = part.where((F.pmod(i, F.lit(43)) != 0) & (F.pmod(i, F.lit(3)) != 0)).select(i.alias("segment_id"), F.pmod(i, F.lit(3)).alias("generation"))
    return entries, catalog


@query
def namespace_audit(spark, d):
    return A.namespace_audit(*_directory(spark, d))


@query
def namespace_issue_counts(spark, d):
    return A.issue_counts(A.namespace_audit(*_directory(spark, d)))


@query
def repair_split(spark, d):
    entries, catalog = _directory(spark, d)
    return A.repair_split(entries, A.namespace_audit(entries, catalog))


@query
def verify_report(spark, d):
    """One row: segments checked, records scanned, segments that do not match, segments too full for another record."""
    p, slots = _placed(spark, d), _slots(spark, d)
    scan = A.committed_scan(p, slots).join(slots.select("segment_id", "committed_end"), "segment_id")
    return scan.agg(F.count("*").alias("segments"), F.sum("scanned").alias("records"), F.count_if(~F.col("matches")).alias("mismatches"), F.count_if(F.col("committed_end") + 128 > CAPACITY).alias("rotations_required"))


@query
def recovery_replay(spark, d):
    """State rebuilt from what was committed: bytes behind the committed end are a crash's tail."""
    p = _placed(spark, d).join(_slots(spark, d).select("segment_id", "committed_end"), "segment_id").where("offset < committed_end")
    return L.live(p, _now(spark, d))


# scalars

@query
def hash_fnv1a(spark, d):
    return logs.read(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key")).withColumn("fnv1a", H.fnv1a_hex("key"))


@query
def index_fingerprints(spark, d):
    """The index's mixed hash and fingerprint of each key."""
    h = H.index_fingerprint("key", SIP_SEED)
    return _log(spark, d).select("key").distinct().select("key", F.substring(h, 1, 16).alias("mixed"), F.substring(h, 17, 2).alias("fingerprint"))


@query
def hash_siphash(spark, d):
    return logs.read(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key")).withColumn("siphash", H.siphash_hex(F.col("key"), SIP_SEED))


@query
def shard_route(spark, d):
    keys = _log(spark, d).select("key").distinct().withColumn("h", H.fnv1a_hex("key"))
    return keys.select("key", H.remainder(F.col("h"), 4).alias("of4"), H.remainder(F.col("h"), 8).alias("of8"), H.remainder(F.col("h"), 13).alias("of13"))


@query
def crc32c_values(spark, d):
    return _log(spark, d).where("value IS NOT NULL").select("sequence", H.crc32c_hex("value").alias("checksum"))


@query
def encoded_sizes(spark, d):
    return _log(spark, d).select("sequence", C.encoded_size(F.col("key"), F.col("value")).alias("size"))


@query
def basis_points(spark, d):
    i = F.col("i")
    return _cases(spark, d).select("i", C.basis_points(F.pmod(i * 7919, F.lit(5000)), F.when(F.pmod(i, F.lit(10)) == 0, 0).otherwise(F.pmod(i * 104729, F.lit(4000)))).alias("bp"))


@query
def key_hex(spark, d):
    keys = _log(spark, d).select("key").distinct().withColumn("hex", F.lower(F.hex(F.encode("key", "utf-8"))))
    return keys.select("key", "hex", F.decode(F.unhex("hex"), "utf-8").alias("back"))


@query
def segment_filename(spark, d):
    i = F.col("p_partkey")
    df = logs.read(spark, d, "part").select(i.alias("segment_id"), C.segment_filename(i * 1_000_003, F.pmod(i, F.lit(70_000)) + 1, A.SUFFIX).alias("name"))
    return df.select("segment_id", "name", F.conv(F.regexp_extract("name", r"^segment-([0-9a-f]{16})-", 1), 16, 10).cast("long").alias("parsed_id"))


@query
def audit_json(spark, d):
    df = logs.read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return D.audit_json(df, ["role", "text"]).select("conv_id", "turn", F.octet_length("json").cast("long").alias("bytes"), F.col("json").startswith('{"role":"').alias("formed"), F.col("json").endswith('..."}').alias("is_cut"))


# decisions

def _observations(spark, d):
    i = F.col("i")
    m = lambda k: F.pmod(i, F.lit(k))
    return _cases(spark, d).select(
        i.alias("case_id"), (m(5) != 0).alias("durable"), F.when(m(7) == 0, 0).otherwise(100).alias("max_segments"), F.pmod(i * 13, F.lit(110)).alias("segments"), F.when(m(3) == 0, None).otherwise(F.pmod(i * 7919, F.lit(300_000_000))).alias("free_bytes"),
        (m(4) * 10_000_000).alias("reserved_bytes"), F.when(m(2) == 0, 0).otherwise(50_000_000).alias("rotate_bytes"), F.when(m(11) == 0, None).otherwise(F.pmod(i * 31, F.lit(10_001))).cast("int").alias("dead_bp"), F.pmod(i * 17, F.lit(5000)).alias("dead_bytes"),
        F.pmod(i * 3, F.lit(2000)).alias("unread_expired_bytes"), F.when(m(13) == 0, 0).otherwise(F.pmod(i * 19, F.lit(9000))).alias("sealed_bytes"), m(6).alias("sealed_segments"), F.pmod(i * 23, F.lit(9000)).alias("live_bytes"), (m(9) == 0).alias("guard_active"),
        m(10).alias("no_gain"), F.pmod(i * 29, F.lit(8000)).alias("rate_used"), F.pmod(i * 37, F.lit(30_000_000)).alias("cpu_used_ns"), (m(27) == 0).alias("debt_override"),
    )


@query
def maintenance_pressure(spark, d):
    return _observations(spark, d).select("case_id", D.pressure(80, 5_000_000).alias("pressure"))


@query
def scheduling_ratio(spark, d):
    return _observations(spark, d).select("case_id", D.scheduling_ratio().alias("bp"))


@query
def maintenance_decision(spark, d):
    return D.maintenance(_observations(spark, d), 5000, 8, 6000, 7000, 25, 80, 5_000_000)


@query
def eval_interval(spark, d):
    return _observations(spark, d).withColumn("pressure", D.pressure(80, 5_000_000)).select("case_id", D.eval_interval().cast("long").alias("interval_ms"))


@query
def status_taxonomy(spark, d):
    return D.status_taxonomy(_cases(spark, d).select(F.pmod("i", F.lit(12)).cast("int").alias("wire_status")).distinct())


@query
def completion_decisions(spark, d):
    i = F.col("i")
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.pmod(F.floor(i / n), F.lit(len(v))) + 1).cast("int"))
    return D.completions(_cases(spark, d).select(i.alias("case_id"), pick(1, "known_not_committed", "committed", "indeterminate").alias("knowledge"), (F.pmod(F.floor(i / 3), F.lit(2)) == 1).alias("error"), pick(6, "not_required", "required", "staged", "published", "failed").alias("publication")))


@query
def lifecycle_violations(spark, d):
    names = list(D.STEPS)
    li = logs.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    stage = F.element_at(F.array(*(F.lit(n) for n in names)), F.least(F.col("l_linenumber") + F.when(F.pmod("p", F.lit(6)) == 0, 1).otherwise(0), F.lit(12)).cast("int"))
    return D.lifecycle_violations(li.select(F.col("l_orderkey").alias("mutation_id"), F.col("l_linenumber").alias("step"), stage.alias("stage")))


@query
def health_ready(spark, d):
    b = lambda k: F.pmod("i", F.lit(k)) != 0
    return D.health(_cases(spark, d).select(F.col("i").alias("case_id"), b(11).alias("started"), b(7).alias("healthy"), (~b(5)).alias("stopping"), b(13).alias("operational"), (~b(6)).alias("mutations_rejected"), F.when(b(4), "idle").otherwise("faulted").alias("maintenance"), (~b(8)).alias("has_error")))


@query
def session_status(spark, d):
    s = _shards(spark, d)
    bound = F.when(F.pmod("sequence", F.lit(10)) == 0, None).when(F.pmod("sequence", F.lit(7)) == 0, 0).otherwise(F.col("shard"))
    return D.session_status(s.select(F.col("sequence").alias("request_id"), bound.alias("bound_worker"), F.col("shard").alias("owner")))


def _grants(spark):
    rows = [("p0", True, True, True, ""), ("p1", True, True, False, ""), ("p2", True, False, False, ""), ("p3", True, False, False, "user:1")]
    return spark.createDataFrame(rows, "principal string, can_read boolean, can_write boolean, can_admin boolean, key_prefix string")


def _requests(spark, d):
    opcode = F.when(F.pmod("sequence", F.lit(3)) == 0, "get").when(F.pmod("sequence", F.lit(50)) == 1, "stats").when(F.pmod("sequence", F.lit(50)) == 2, "bind_worker").when(F.pmod("sequence", F.lit(50)) == 4, "backup").when(F.col("opcode") == S.ERASE, "erase").otherwise("put")
    return _log(spark, d).select(F.col("sequence").alias("request_id"), opcode.alias("opcode"), "key", F.when(opcode == "put", F.col("value")).alias("value"), F.when(opcode == "put", F.col("expire_at_ns")).otherwise(0).alias("expire_at_ns"), F.concat(F.lit("p"), F.pmod("user_id", F.lit(5)).cast("string")).alias("principal"), F.col("commit_ns").alias("arrival"))


@query
def authz_decisions(spark, d):
    return D.authorized(_requests(spark, d), _grants(spark)).select("request_id", "principal", "opcode", "decision")


@query
def authz_parse(spark, d):
    """Grant lines made from customers: good ones, comments, and every kind of mistake."""
    i = F.col("c_custkey")
    m = F.pmod(i, F.lit(9))
    name = F.concat(F.lit("user-"), i.cast("string"))
    line = (
        F.when(m == 0, F.concat(F.lit("# "), name)).when(m == 1, F.concat(name, F.lit(" read"))).when(m == 2, F.concat(name, F.lit("\tread,write"))).when(m == 3, F.concat(name, F.lit(" admin # all")))
        .when(m == 4, F.concat(name, F.lit("  read prefix=tenant/"), i.cast("string"))).when(m == 5, F.concat(name, F.lit(" write prefix="))).when(m == 6, F.concat(name, F.lit(" owner"))).when(m == 7, name).otherwise(F.concat(name, F.lit(" read scope=x")))
    )
    return D.parse_grants(logs.read(spark, d, "customer").select(i.alias("line_no"), line.alias("line")))


@query
def request_validation(spark, d):
    r = _requests(spark, d)
    broken = r.withColumn("key", F.when(F.pmod("request_id", F.lit(37)) == 0, "").when(F.col("opcode").isin("stats", "bind_worker"), "").otherwise(F.col("key"))).withColumn("expire_at_ns", F.when(F.pmod("request_id", F.lit(41)) == 0, 5).otherwise(F.col("expire_at_ns")))
    broken = broken.withColumn("target_worker", F.when(F.col("opcode") == "bind_worker", F.pmod("request_id", F.lit(8))).when(F.pmod("request_id", F.lit(43)) == 0, 1))
    return D.request_validity(broken)


@query
def admission_pipeline(spark, d):
    r = D.authorized(_requests(spark, d), _grants(spark))
    r = r.withColumn("draining", F.pmod("request_id", F.lit(97)) == 0).withColumn("connection_ok", F.pmod("request_id", F.lit(53)) != 0).withColumn("principal_ok", F.pmod("request_id", F.lit(59)) != 0)
    return D.admission(r)


@query
def worker_count_choice(spark, d):
    i = F.col("i")
    return D.worker_count(_cases(spark, d).select(i.alias("case_id"), F.when(F.pmod(i, F.lit(6)) == 0, F.pmod(i, F.lit(300))).alias("explicit"), F.pmod(i, F.lit(65)).alias("cores"), F.pmod(i * 3, F.lit(70)).alias("cpus"), F.when(F.pmod(i, F.lit(4)) == 0, 0).otherwise(F.pmod(i * 7919, F.lit(4_000_000_000))).alias("memory"), F.pmod(i, F.lit(5)).alias("reserved"), F.lit(32).alias("most"), F.lit(S.SEGMENT_BYTES).alias("least_memory")))


@query
def hot_cache_admission(spark, d):
    s = _shards(spark, d).where("value IS NOT NULL").select("shard", "key", "sequence", F.octet_length("value").alias("bytes"))
    return D.hot_cache_admission(s, 40, 8000, 400)


@query
def live_key_limits(spark, d):
    return D.live_key_limits(spark, 1003, SHARDS)


@query
def resource_limits(spark, d):
    p = _placed(spark, d)
    usage = p.agg(F.countDistinct("segment_id").alias("segments"), F.sum("size").alias("record_bytes"), F.countDistinct("key").alias("keys"))
    return D.resource_limits(usage, {"segments": 64, "record_bytes": 2_000_000, "keys": 100})


# folds

@query
def quota_admission(spark, d):
    r = _requests(spark, d).select("principal", "request_id", F.floor(F.col("arrival") / 1000).alias("arrival"), (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long").alias("bytes"))
    return X.quota_admission(r.withColumn("arrival", F.col("arrival").cast("long")), 3, 120).select("request_id", "principal", "status")


@query
def batch_closes(spark, d):
    s = _placed(spark, d).select("shard", "sequence", F.floor(F.col("commit_ns") / 40_000).alias("arrival"), F.col("size").alias("bytes"), F.pmod(F.col("sequence") * 31, F.lit(41)).alias("waiting"))
    return X.batch_closes(s, 32, 2500, 10_000_000).select("shard", "sequence", "batch", "closed_before", "closed_by")


@query
def latency_guard(spark, d):
    e = _shards(spark, d).select("shard", F.col("sequence").alias("look"), F.col("commit_ns").alias("now_ns"), F.pmod(F.col("sequence") * 7919, F.lit(30_000_000)).alias("p99_ns"), F.pmod("sequence", F.lit(200)).alias("samples"))
    return X.latency_guard(e, 20_000_000, 2_000_000_000_000, 32).select("shard", "look", "verdict")


@query
def rate_budget(spark, d):
    s = _placed(spark, d).select("shard", F.col("sequence").alias("copy_id"), F.floor(F.col("commit_ns") / 100_000).alias("now_ns"), F.col("size").alias("bytes"))
    return X.rate_budget(s, 600).select("shard", "copy_id", "verdict", "left_bytes")


@query
def connection_timeouts(spark, d):
    e = logs.read(spark, d, "events").select(F.col("user_id").alias("connection"), "event_id", logs.nanoseconds("ts").alias("at_ns"))
    return X.timeouts(e, 60_000 * 1_000_000_000)


@query
def publication_epochs(spark, d):
    return X.publication_epochs(_shards(spark, d))


# metrics

def _samples(spark, d):
    return logs.read(spark, d, "events").select((F.col("value") * 100_000).cast("long").alias("ns"), "event_type", "value")


@query
def latency_histogram(spark, d):
    return M.histogram(_samples(spark, d), "ns")


@query
def latency_percentiles(spark, d):
    return M.percentiles(_samples(spark, d), "ns", [0.0, 0.5, 0.9, 0.99, 0.999, 1.0])


@query
def foreground_p99(spark, d):
    return M.foreground_p99(_samples(spark, d), "ns")


@query
def stats_report(spark, d):
    return M.stats_report(logs.read(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("at"), (F.col("value") * 100).cast("long").alias("value")))


@query
def bench_summary(spark, d):
    return M.bench_summary(_samples(spark, d), "event_type", "ns")


# streams

def _stream(spark, d):
    schema = logs.read(spark, d, "events").schema
    return logs.events_as_log(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


@query
def stream_live(spark, d):
    from tidelog.streaming import live

    out = live.run_available(spark, live.latest_stream(_stream(spark, d)), "complete")
    return out.where(F.col("opcode") == S.PUT).select("key", "value", "sequence")


@query
def stream_ttl(spark, d):
    from tidelog.streaming import live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return live.run_available(spark, live.outcome_stream(_stream(spark, d).drop("user_id")), "append")
