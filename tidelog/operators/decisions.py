"""Decision tables as CASE expressions over one row per case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions.scalars import basis_points, ceil_percentage, has_prefix

#: Opcodes that touch a key, and probes that stay answered while a server drains or is limited.
KEYED, PROBES = ("get", "put", "erase"), ("health", "ready", "stats")


def _free_blocks() -> Column:
    return F.col("free_bytes").isNotNull() & (F.col("free_bytes") < F.col("reserved_bytes") + F.when(F.col("rotate_bytes") != 0, F.col("rotate_bytes")).otherwise(S.SEGMENT_BYTES))


def pressure(percent: int = 80, margin: int = 0) -> Column:
    """Space pressure of an observation ``(durable, max_segments, segments, free_bytes, reserved_bytes, rotate_bytes)``; null free bytes are unknown."""
    full = (F.col("max_segments") > 0) & (F.col("segments") >= F.col("max_segments"))
    many = (F.col("max_segments") > 0) & (F.col("segments") >= ceil_percentage(F.col("max_segments"), percent))
    little = F.col("free_bytes").isNotNull() & (F.col("free_bytes") <= F.col("reserved_bytes") + margin)
    return F.when(~F.col("durable"), "normal").when(full | _free_blocks(), "emergency").when(many | little, "pressure").otherwise("normal")


def scheduling_ratio() -> Column:
    """Dead ratio of a candidate with its unread-expired bytes counted dead; the plain ratio where there is no candidate data."""
    dead = F.least(F.col("dead_bytes") + F.col("unread_expired_bytes"), F.col("sealed_bytes"))
    return F.when(F.col("dead_bp").isNull() | (F.col("sealed_bytes") == 0), F.col("dead_bp")).otherwise(basis_points(dead, F.col("sealed_bytes")))


def maintenance(cases: DataFrame, normal_bp: int = 5000, most_no_gain: int = 8, cycle_bytes: int = 0, rate_bytes: int = 0, cpu_ms: int = 0, percent: int = 80, margin: int = 0) -> DataFrame:
    """``(case_id, pressure, decision, reason)``: the first skip reason that applies, else why the work runs.

    Cases also have ``sealed_segments, live_bytes, guard_active, no_gain, rate_used, cpu_used_ns, debt_override``. A zero
    limit is switched off; pressure overrides every budget.
    """
    df = cases.withColumn("pressure", pressure(percent, margin)).withColumn("bp", scheduling_ratio())
    calm = F.col("pressure") == "normal"
    left = F.lit(rate_bytes) - F.col("rate_used")
    budget = F.least(*(x for x, on in ((F.lit(cycle_bytes), cycle_bytes), (left, rate_bytes)) if on)) if cycle_bytes and rate_bytes else left
    skip = F.when(F.col("durable") & (F.col("sealed_segments") == 0), "no_candidate")
    skip = skip.when(calm & F.col("durable") & (F.col("bp") < normal_bp), "reclaim_threshold").when(calm & F.col("guard_active") & ~F.col("debt_override"), "latency_budget")
    if most_no_gain:
        skip = skip.when(calm & (F.col("no_gain") >= most_no_gain), "budget_backoff")
    if cycle_bytes:
        skip = skip.when(calm & F.col("durable") & (F.col("live_bytes") > cycle_bytes), "copy_budget")
    if cpu_ms:
        skip = skip.when(calm & (F.col("cpu_used_ns") >= cpu_ms * 1_000_000), "rate_budget")
    if rate_bytes:
        skip = skip.when(calm & ((left <= 0) | F.col("durable") & (F.col("live_bytes") > budget)), "rate_budget")
    little = F.col("free_bytes").isNotNull() & (F.col("free_bytes") <= F.col("reserved_bytes") + margin)
    run = (
        F.when(F.col("pressure") == "emergency", "emergency_capacity").when(F.col("pressure") == "pressure", F.when(little, "free_space_pressure").otherwise("segment_pressure"))
        .when(F.col("debt_override"), "latency_debt_override").when(F.col("durable") & (F.col("sealed_segments") > 0), "sealed_history").otherwise("scheduled")
    )
    df = df.withColumn("skip", skip.otherwise(None))
    return df.select("case_id", "pressure", F.when(F.col("skip").isNull(), "run").otherwise("skip").alias("decision"), F.coalesce("skip", run).alias("reason"))


def eval_interval(least_ms: int = 1000, most_ms: int = 60_000, most_no_gain: int = 8) -> Column:
    """Milliseconds to the next look: least under pressure, most in backoff, else midway."""
    low = max(least_ms, 1)
    high = max(most_ms, low)
    hard = F.col("pressure").isin("pressure", "emergency")
    return F.when(hard, low).when(F.lit(most_no_gain > 0) & (F.col("no_gain") >= most_no_gain), high).otherwise(low + (high - low) // 2)


def status_taxonomy(statuses: DataFrame) -> DataFrame:
    """What a wire status means to a client: category, outcome of a mutation, when to try again, connection health."""
    s = F.col("wire_status")
    category = (
        F.when(s == 0, "ok").when(s.isin(1, 2), "invalid_argument").when(s == 3, "internal").when(s == 4, "not_found").when(s == 5, "overloaded").when(s == 7, "unavailable")
        .when(s == 8, "permission_denied").otherwise("protocol")
    )
    df = statuses.withColumn("category", category)
    outcome = F.when(s == 0, "committed").when(s.isin(1, 2, 4, 5, 6, 7, 8), "rejected").otherwise("indeterminate")
    c = F.col("category")
    final = c.isin("overloaded", "permission_denied", "unavailable")
    read = F.when(s == 0, "none").when(final | (c == "invalid_argument"), "never").otherwise("new_attempt")
    write = F.when(s == 0, "none").when(outcome == "indeterminate", "reconcile_first").when(final, "never").when(c == "not_found", "new_attempt").otherwise("reconcile_first")
    pipeline = F.when(s == 0, "committed").when(outcome == "indeterminate", "indeterminate").otherwise("failed")
    return df.select("wire_status", "category", read.alias("read_retry"), outcome.alias("mutation_outcome"), write.alias("mutation_retry"), pipeline.alias("pipeline_outcome"), s.isin(6, 7).alias("unhealthy"))


def completions(cases: DataFrame) -> DataFrame:
    """The answer to a mutation from what is known of its commit ``(entered, knowledge, error, publication)``."""
    shown = F.col("publication") == "published"
    never = F.col("knowledge") == "known_not_committed"
    unsure = F.col("knowledge") == "indeterminate"
    kind = F.when(never, "known_not_committed").when(unsure, "indeterminate").when(shown, "success").otherwise("indeterminate")
    closed = F.when(never, False).when(unsure, True).otherwise(F.col("error") | ~shown)
    drain = F.when(never, False).when(unsure, True).otherwise(~shown)
    return cases.select("case_id", kind.alias("kind"), closed.alias("fail_closed"), drain.alias("drain"))


# The legal steps of a mutation's life.
STEPS = {
    "not_admitted": "admitted", "admitted": "staged rejected expired_pre_store", "staged": "durable_started expired_pre_store rejected", "expired_pre_store": "completion_decided rejected completed",
    "durable_started": "authority_committed rejected indeterminate publication_required", "authority_committed": "publication_required", "publication_required": "published indeterminate",
    "published": "completion_decided", "indeterminate": "completion_decided publication_required", "rejected": "completion_decided completed", "completion_decided": "completed", "completed": "",
}


def lifecycle_violations(stages: DataFrame) -> DataFrame:
    """Steps ``(mutation_id, step, stage)`` that may not follow the one before; staying is allowed."""
    from pyspark.sql import window as W

    legal = F.map_from_arrays(F.array(*(F.lit(k) for k in STEPS)), F.array(*(F.array(*(F.lit(x) for x in v.split())).cast("array<string>") for v in STEPS.values())))
    before = F.lag("stage").over(W.Window.partitionBy("mutation_id").orderBy("step"))
    df = stages.withColumn("before", before)
    bad = F.col("before").isNotNull() & (F.col("before") != F.col("stage")) & ~F.coalesce(F.array_contains(F.try_element_at(legal, F.col("before")), F.col("stage")), F.lit(False))
    return df.where(bad).select("mutation_id", "step", "before", "stage")


def health(cases: DataFrame) -> DataFrame:
    live = F.col("started") & F.col("healthy")
    ready = live & ~F.col("stopping") & F.col("operational") & ~F.col("mutations_rejected") & ~((F.col("maintenance") == "faulted") & F.col("has_error"))
    return cases.select("case_id", live.alias("live"), ready.alias("ready"))


def session_status(requests: DataFrame) -> DataFrame:
    """not_bound without a worker, wrong_owner on another's key, else ok: ``(request_id, bound_worker, owner)``."""
    s = F.when(F.col("bound_worker").isNull(), "not_bound").when(F.col("bound_worker") != F.col("owner"), "wrong_owner").otherwise("ok")
    return requests.select("request_id", s.alias("status"), "owner")


def required(opcode: Column, prefix: Column) -> Column:
    """The capability an opcode needs; statistics of the whole server are not for principals held to a prefix."""
    return (
        F.when(opcode.isin("init", "bind_worker", "health", "ready"), "none").when(opcode.isin("ping", "get"), "read")
        .when(opcode == "stats", F.when(F.coalesce(F.length(prefix), F.lit(0)) == 0, "read").otherwise("admin")).when(opcode.isin("put", "erase"), "write").otherwise("admin")
    )


def authorized(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Adds ``decision``: allowed, capability_denied or prefix_denied. Admin implies write and read, write implies read; an unknown principal has nothing.

    ``grants`` joins by principal; Catalyst broadcasts it only while its size allows.
    """
    df = requests.join(grants, "principal", "left")
    need = required(F.col("opcode"), F.col("key_prefix"))
    admin, write, read = (F.coalesce(F.col(c), F.lit(False)) for c in ("can_admin", "can_write", "can_read"))
    may = F.when(need == "none", True).when(need == "admin", admin).when(need == "write", admin | write).otherwise(admin | write | read)
    inside = ~F.col("opcode").isin(*KEYED) | has_prefix(F.coalesce("key", F.lit("")), F.coalesce("key_prefix", F.lit("")))
    decision = F.when(~may, "capability_denied").when(~inside, "prefix_denied").otherwise("allowed")
    return df.withColumn("decision", decision).select(*requests.columns, "decision")


def parse_grants(lines: DataFrame) -> DataFrame:
    """``principal caps [prefix=bytes]`` lines to rows with flags and an error; blank and ``#`` lines are left out."""
    text = F.btrim(F.regexp_replace("line", r"#.*$", ""), F.lit(" \t\r"))
    df = lines.withColumn("t", text).where("t <> ''").withColumn("f", F.split("t", r"[ \t]+"))
    caps = F.transform(F.split(F.try_element_at("f", F.lit(2)), ","), lambda c: F.trim(c))
    df = df.withColumn("caps", F.coalesce(caps, F.array().cast("array<string>"))).withColumn("rest", F.try_element_at("f", F.lit(3)))
    known = F.forall("caps", lambda c: c.isin("read", "write", "admin"))
    error = (
        F.when(F.size("caps") == 0, "missing_capabilities").when(~known, "unknown_capability").when(F.size("f") > 3, "trailing_text")
        .when(F.col("rest").isNotNull() & ~F.col("rest").startswith("prefix="), "expected_prefix").when(F.col("rest") == "prefix=", "empty_prefix")
    )
    has = lambda c: F.array_contains("caps", c)
    admin = has("admin")
    return df.withColumn("error", error).select(
        "line_no", F.element_at("f", 1).alias("principal"), (admin | has("write") | has("read")).alias("can_read"), (admin | has("write")).alias("can_write"), admin.alias("can_admin"),
        F.when(F.col("error").isNull(), F.coalesce(F.substring(F.col("rest"), F.lit(8), F.length("rest")), F.lit(""))).alias("key_prefix"), "error",
    )


def request_validity(requests: DataFrame) -> DataFrame:
    """Whether each request ``(request_id, opcode, key, value, expire_at_ns, target_worker)`` carries just the fields its opcode may."""
    key, value = (F.length(F.coalesce(c, F.lit(""))) > 0 for c in ("key", "value"))
    expiry, target = F.col("expire_at_ns") != 0, F.col("target_worker").isNotNull()
    op = F.col("opcode")
    ok = (
        F.when(op.isin("init", "health", "ready", "stats"), ~(key | value | expiry | target)).when(op == "ping", ~(key | expiry | target))
        .when(op.isin("backup", "get", "erase"), key & ~(value | expiry | target)).when(op == "put", key & ~target).when(op == "bind_worker", target & ~(key | value | expiry)).otherwise(False)
    )
    return requests.select("request_id", "opcode", F.when(ok, "ok").otherwise("invalid_request").alias("status"))


def admission(requests: DataFrame) -> DataFrame:
    """The first gate that stops a request ``(request_id, opcode, draining, decision, connection_ok, principal_ok)``, or what happens to it."""
    probe = F.col("opcode").isin(*PROBES)
    out = (
        F.when(F.col("draining") & ~probe, "overloaded:draining").when(F.col("decision") != "allowed", F.concat(F.lit("permission_denied:"), F.col("decision")))
        .when(~probe & ~F.col("connection_ok"), "overloaded:connection").when(~probe & ~F.col("principal_ok"), "overloaded:principal").when(F.col("opcode") == "bind_worker", "bind").otherwise("dispatch")
    )
    return requests.select("request_id", out.alias("outcome"))


def worker_count(cases: DataFrame) -> DataFrame:
    """Workers for a machine ``(case_id, explicit, cores, cpus, memory, reserved, most, least_memory)``."""
    cap = F.greatest(F.lit(1), F.col("most"))
    cores = F.greatest(F.lit(1), F.least("cores", "cpus"))
    spare = F.when(cores > F.col("reserved"), cores - F.col("reserved")).otherwise(1)
    count = F.least(spare, cap)
    by_memory = F.greatest(F.lit(1), F.floor(F.col("memory") / F.col("least_memory")))
    auto = F.when((F.col("memory") != 0) & (F.col("least_memory") != 0), F.least(count, by_memory)).otherwise(count)
    picked = F.when(F.col("explicit").isNotNull(), F.least(F.greatest("explicit", F.lit(1)), cap)).otherwise(F.greatest(F.lit(1), auto))
    return cases.select("case_id", picked.cast("long").alias("workers"))


def hot_cache_admission(values: DataFrame, most_value: int, most_bytes: int, most_entries: int) -> DataFrame:
    """Which values of each shard fit its cache, in sequence order: small enough, and within byte and entry budgets of what came before."""
    from pyspark.sql import window as W

    w = W.Window.partitionBy("shard").orderBy("sequence").rowsBetween(W.Window.unboundedPreceding, 0)
    fits = F.col("bytes") <= most_value
    df = values.withColumn("fits", fits).withColumn("sum", F.sum(F.when(F.col("fits"), F.col("bytes")).otherwise(0)).over(w)).withColumn("n", F.sum(F.when(F.col("fits"), 1).otherwise(0)).over(w))
    status = F.when(~F.col("fits"), "value_too_large").when(F.col("n") > most_entries, "entry_budget").when(F.col("sum") > most_bytes, "byte_budget").otherwise("admitted")
    return df.select("shard", "key", "sequence", status.alias("status"))


def live_key_limits(spark, total: int, workers: int) -> DataFrame:
    """Each worker's share of a key limit; the first ones take the remainder."""
    return spark.range(workers).select(F.col("id").cast("int").alias("worker"), (F.lit(total // workers) + (F.col("id") < total % workers).cast("int")).cast("long").alias("key_limit"))


def resource_limits(usage: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``(resource, used, allowed, exceeded)`` for the measures of a one-row ``usage`` that have a limit."""
    pairs = F.array(*(F.struct(F.lit(k).alias("resource"), F.col(k).cast("long").alias("used"), F.lit(v).cast("long").alias("allowed")) for k, v in limits.items()))
    return usage.select(F.explode(pairs).alias("p")).select("p.*").withColumn("exceeded", F.col("used") > F.col("allowed"))


def audit_json(rows: DataFrame, columns: list[str], most: int = 256) -> DataFrame:
    """A JSON line of each row's text columns, each cut at ``most`` bytes; a cut leaves no broken character."""
    def esc(c: str) -> Column:
        raw = F.encode(F.coalesce(F.col(c), F.lit("")), "utf-8")
        cut = F.when(F.length(raw) > most, F.concat(F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, most).cast("string")), "\uFFFD+$", ""), F.lit("..."))).otherwise(F.coalesce(F.col(c), F.lit("")))
        steps = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
        return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), steps, cut)
    parts = [F.concat(F.lit(f'"{c}":"'), esc(c), F.lit('"')) for c in columns]
    return rows.withColumn("json", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
