from tidelog.operators import audit, decisions, folds, metrics, segments

LOG = "key string, sequence long, opcode int, value string, expire_at_ns long, commit_ns long, shard int"


def placed(spark, rows, capacity=4096 + 128):
    df = spark.createDataFrame([(k, s, o, v, 0, s, 0) for k, s, o, v in rows], LOG)
    return segments.placed(df, capacity)


def test_next_fit_opens_a_segment_where_a_record_does_not_fit(spark):
    p = placed(spark, [("a", 1, 1, ""), ("b", 2, 1, "x" * 60), ("c", 3, 1, ""), ("d", 4, 1, "")])
    got = [(r["sequence"], r["segment_no"], r["offset"], r["role"]) for r in p.orderBy("sequence").collect()]
    assert got == [(1, 0, 4096, "sealed"), (2, 1, 4096, "sealed"), (3, 2, 4096, "active"), (4, 2, 4160, "active")]


def test_an_erase_that_hides_an_older_put_is_not_retired(spark):
    # the erase of a stands alone in a sealed segment; its put is in another
    p = placed(spark, [("a", 1, 1, "x"), ("b", 2, 1, "x"), ("a", 3, 2, None), ("c", 4, 2, None), ("d", 5, 1, "x"), ("e", 6, 1, "x")])
    assert [r["segment_id"] for r in segments.retirable(p).collect()] == []
    free = placed(spark, [("a", 1, 2, None), ("c", 2, 2, None), ("d", 3, 1, "x"), ("e", 4, 1, "x")])
    assert [r["segment_id"] for r in segments.retirable(free).collect()] == [1]
    fate = {(r["segment_id"], r["action"]): r["records"] for r in segments.vacuum_result(p, 0, most_ratio=0.25, limit=9).collect()}
    assert fate[2, "kept_tombstone"] == 2


def test_whole_shard_compaction_drops_erases_with_what_they_hide(spark):
    p = placed(spark, [("a", 1, 1, "x"), ("b", 2, 1, "x"), ("a", 3, 2, None), ("c", 4, 1, "x"), ("d", 5, 1, "x"), ("e", 6, 1, "x")])
    assert {r["key"] for r in segments.compaction_build(p, 0, 4096 + 128).collect()} == {"b", "c"}
    plan = {r["segment_id"]: (r["action"], r["generation"]) for r in segments.compaction_plan(p, 0, 4096 + 128).collect()}
    assert plan == {1: ("replaced", 2), 2: ("removed", 1)}


def test_transition_accepts_the_canonical_next_catalog(spark):
    schema = "segment_id long, generation int, owner int, role string"
    now = spark.createDataFrame([(1, 1, 0, "sealed"), (2, 1, 0, "sealed"), (3, 1, 0, "active"), (4, 1, 1, "sealed")], schema)
    good = spark.createDataFrame([(1, 2, 0, "sealed"), (3, 1, 0, "active"), (4, 1, 1, "sealed")], schema)
    bad = spark.createDataFrame([(2, 2, 0, "sealed"), (3, 1, 0, "active"), (4, 1, 1, "sealed")], schema)
    assert audit.transition(now, good, 0).count() == 0
    assert {(r["segment_id"], r["problem"]) for r in audit.transition(now, bad, 0).collect()} == {(1, "missing"), (2, "unexpected")}


def test_quota_windows_start_at_events_and_refusals_cost_nothing(spark):
    s = folds.SECOND
    rows = [("p", 1, 100, 10), ("p", 2, 200, 95), ("p", 3, 300, 80), ("p", 4, 400, 1), ("p", 5, 100 + s, 50), ("q", 6, 100, 101)]
    df = spark.createDataFrame(rows, "principal string, request_id long, arrival long, bytes long")
    got = {r["request_id"]: r["status"] for r in folds.quota_admission(df, 2, 100).collect()}
    assert got == {1: "admitted", 2: "byte_quota", 3: "admitted", 4: "request_quota", 5: "admitted", 6: "byte_quota"}


def test_group_commit_shrinks_after_a_deadline(spark):
    rows = [(0, 1, 0, 8), (0, 2, 1, 8), (0, 3, 100, 8), (0, 4, 101, 8), (0, 5, 102, 8)]
    df = spark.createDataFrame(rows, "shard int, sequence long, arrival long, bytes long")
    got = [(r["batch"], r["closed_before"], r["closed_by"]) for r in folds.batch_closes(df, 4, 1000, 50).orderBy("sequence").collect()]
    assert got == [(0, None, None), (0, None, None), (1, "deadline", None), (1, None, "target"), (2, None, None)]


def test_group_commit_grows_again_while_more_producers_wait(spark):
    rows = [(0, i + 1, at, 8, waiting) for i, (at, waiting) in enumerate([(0, 1), (1, 1), (100, 1), (101, 3), (102, 1), (103, 9), (104, 2), (105, 0)])]
    df = spark.createDataFrame(rows, "shard int, sequence long, arrival long, bytes long, waiting long")
    got = [(r["batch"], r["closed_before"], r["closed_by"]) for r in folds.batch_closes(df, 4, 1000, 50).orderBy("sequence").collect()]
    assert got == [(0, None, None), (0, None, None), (1, "deadline", None), (1, None, "target"), (2, None, None), (2, None, None), (2, None, "target"), (3, None, None)]


def test_latency_guard_has_hysteresis_and_a_longest_deferral(spark):
    ms = 1_000_000
    rows = [(0, 1, 0, 9 * ms, 40), (0, 2, 1, 10 * ms, 40), (0, 3, 2, 9 * ms, 40), (0, 4, 3, 7 * ms, 40), (0, 5, 4, 12 * ms, 40), (0, 6, 99, 12 * ms, 40), (0, 7, 100, 12 * ms, 3)]
    df = spark.createDataFrame(rows, "shard int, look long, now_ns long, p99_ns long, samples long")
    got = [r["verdict"] for r in folds.latency_guard(df, 10 * ms, 50, 32).orderBy("look").collect()]
    assert got == ["run", "suspended", "suspended", "run", "suspended", "override", "run"]


def test_rate_budget(spark):
    rows = [(0, 1, 10, 60), (0, 2, 20, 50), (0, 3, 30, 40), (0, 4, 10 + folds.SECOND, 50)]
    df = spark.createDataFrame(rows, "shard int, copy_id long, now_ns long, bytes long")
    assert [r["verdict"] for r in folds.rate_budget(df, 100).orderBy("copy_id").collect()] == ["run", "refused", "run", "run"]


def test_golden_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (500, 5_000, 50_000, 5_000_000, 50_000_000)], "ns long")
    assert [r["cumulative"] for r in metrics.histogram(df, "ns").orderBy("bucket").collect()] == [1, 2, 3, 3, 4, 5, 5, 5]
    assert metrics.foreground_p99(df.where("ns > 99"), "ns").first()["p99_ns"] == 50_000_000
    empty = df.where("ns < 0")
    assert {r["value_ns"] for r in metrics.percentiles(empty, "ns", [0.5]).collect()} == {0}
    assert tuple(metrics.foreground_p99(empty, "ns").first()) == (0, 0)


def test_status_table(spark):
    got = {r["wire_status"]: r for r in decisions.status_taxonomy(spark.createDataFrame([(s,) for s in (3, 5, 6, 99)], "wire_status int")).collect()}
    assert (got[3]["mutation_outcome"], got[5]["read_retry"], got[6]["unhealthy"], got[99]["category"]) == ("indeterminate", "never", True, "protocol")
