import random

import pytest

from tidelog.operators import folds, latest

SCHEMA = "key string, sequence long, opcode int, value string, expire_at_ns long, commit_ns long"


def log(spark, rows):
    return spark.createDataFrame([(k, s, o, v, e, s) for k, s, o, v, e in rows], SCHEMA)


def state(df):
    return {r["key"]: (r["value"], r["sequence"]) for r in df.collect()}


def test_latest_is_picked_before_erase_and_expiry(spark):
    df = log(spark, [("a", 1, 1, "x", 0), ("a", 2, 2, None, 0), ("b", 1, 1, "x", 0), ("b", 2, 1, "y", 10), ("c", 1, 1, "z", 10)])
    assert state(latest.live(df, 10)) == {}
    assert state(latest.live(df, 9)) == {"b": ("y", 2), "c": ("z", 1)}
    assert state(latest.live(df, 0)) == {"b": ("y", 2), "c": ("z", 1)}
    r = latest.rebuild_stats(df, 10).first()
    assert (r["records_scanned"], r["tombstones"], r["expired"], r["visible"]) == (5, 1, 2, 0)


def test_empty_log(spark):
    df = log(spark, [])
    assert latest.live(df, 0).count() == 0
    assert tuple(latest.rebuild_stats(df, 0).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("seed", range(6))
def test_random_histories_rebuild_to_a_model(spark, seed):
    rng, rows, model = random.Random(seed), [], {}
    for s in range(1, 251):
        k = f"k{rng.randrange(31)}"
        if rng.randrange(5) == 0:
            rows.append((k, s, 2, None, 0))
            model.pop(k, None)
        else:
            rows.append((k, s, 1, f"v{s}", 0))
            model[k] = (f"v{s}", s)
    rng.shuffle(rows)
    df = log(spark, rows)
    assert state(latest.live(df, 0)) == model
    cut = df.where("sequence > 120")
    assert state(latest.overlay(latest.as_of(df, 120), cut)) == model


def test_multi_get_reports_misses_in_any_order(spark):
    df = log(spark, [("a", 1, 1, "x", 0)])
    probes = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a")], "pos int, key string")
    got = {r["pos"]: (r["status"], r["value"]) for r in latest.multi_get(df, probes, 0).collect()}
    assert got == {0: ("not_found", None), 1: ("ok", "x"), 2: ("ok", "x")}


def test_history_check_finds_only_impossible_histories(spark):
    rows = [
        ("ok", 1, "put", "1", None, 0, 10), ("ok", 2, "get", None, "1", 5, 6), ("ok", 3, "get", None, None, 1, 7),
        ("bad", 1, "put", "1", None, 0, 1), ("bad", 2, "get", None, None, 2, 3),
        ("erase", 1, "put", "1", None, 0, 1), ("erase", 2, "erase", None, None, 2, 5), ("erase", 3, "get", None, "1", 3, 4), ("erase", 4, "get", None, None, 6, 7),
    ]
    df = spark.createDataFrame(rows, "key string, id long, kind string, value string, seen string, call long, ret long")
    assert [r["key"] for r in folds.history_check(df).collect()] == ["bad"]


def _explained(ops):
    """Whether some order of all operations respects real time and explains the gets."""
    from itertools import permutations

    for order in permutations(ops):
        if any(b[5] < a[4] for i, a in enumerate(order) for b in order[i + 1 :]):
            continue
        now = None
        for kind, value, seen in (o[1:4] for o in order):
            if kind == "get" and seen != now:
                break
            now = now if kind == "get" else value if kind == "put" else None
        else:
            return True
    return False


def test_history_check_equals_brute_force(spark):
    import random

    rng, rows = random.Random(1), []
    for k in range(150):
        for i in range(rng.randrange(1, 7)):
            kind, at = rng.choice(["put", "get", "get", "erase"]), rng.randrange(12)
            rows.append((f"k{k}", i, kind, rng.choice("ab") if kind == "put" else None, rng.choice(["a", "b", None]) if kind == "get" else None, at, at + rng.randrange(6)))
    keys = {r[0] for r in rows}
    want = {k: len(ops) for k in keys if not _explained(ops := [r[1:] for r in rows if r[0] == k])}
    assert 20 < len(want) < len(keys) - 20
    df = spark.createDataFrame(rows, "key string, id long, kind string, value string, seen string, call long, ret long")
    assert {r["key"]: r["operations"] for r in folds.history_check(df).collect()} == want


def test_history_query_checks_every_event(spark, tmp_path):
    import datetime

    from tidelog.plans.queries import QUERIES

    at = datetime.datetime(2024, 1, 1)
    # the only wrong answer is a get of another part of the ids, long after a user's eighth operation
    rows = [(i, 1, "click", float(i), at) for i in range(1, 35)] + [(36, 1, "view", 36.0, at)] + [(i, 2, "click", float(i), at) for i in range(100, 140)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["history_check"](spark, str(tmp_path)).collect()] == [("user:1", 35)]
