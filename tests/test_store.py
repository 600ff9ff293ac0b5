import pytest

from tidelog.store import Store

ITEMS = "pos int, key string, value string, expire_at_ns long"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", 4)


def probe(spark, *keys):
    return spark.createDataFrame(list(enumerate(keys)), "pos int, key string")


def answers(df):
    return [tuple(r)[1:] for r in sorted(df.collect())]


def test_verbs(spark, store, tmp_path):
    status = store.put(spark.createDataFrame([(0, "a", "1", 0), (1, "b", "2", 50), (2, None, "x", 0), (3, "a", "3", None)], ITEMS))
    assert answers(status) == [("ok",), ("ok",), ("invalid_argument",), ("ok",)]
    assert answers(store.get(probe(spark, "a", "b", "c"), 10).select("pos", "status", "value")) == [("ok", "3"), ("ok", "2"), ("not_found", None)]
    assert answers(store.get(probe(spark, "b"), 50).select("pos", "status")) == [("not_found",)]
    assert answers(store.erase(probe(spark, "a", "zz", "a"))) == [("erased",), ("not_found",), ("not_found",)]
    assert {r["key"] for r in store.live().collect()} == {"b"}
    assert tuple(store.stats().first()) == (4, 1, 0, 1)
    assert store.verify().count() == 0
    report = store.backup(f"file://{tmp_path}/copy").first()
    assert report["equal"] and report["copy_rows"] == 4
    store.compact()
    assert store.log().count() == 1 and {r["key"] for r in Store(spark, store.path).live().collect()} == {"b"}
    before = store.flush()
    store.put(spark.createDataFrame([(0, "b", "9", 0), (1, "", "x", 0)], ITEMS))
    assert store.flush() == before + 1
    assert answers(store.get(probe(spark, "b")).select("pos", "value")) == [("9",)]
    other = store.reshard(f"file://{tmp_path}/other", 7)
    assert other.verify().count() == 0 and other.live().count() == 1


def test_sequences_go_on_after_a_compaction(spark, tmp_path):
    one = Store(spark, f"file://{tmp_path}/one", 1)
    one.put(spark.createDataFrame([(0, "a", "1", 0), (1, "b", "2", 0)], ITEMS))
    one.erase(probe(spark, "a"))
    one.erase(probe(spark, "b"))
    one.compact()
    assert one.log().count() == 0
    assert answers(one.put(spark.createDataFrame([(0, "a", "3", 0), (1, "", "4", 0)], ITEMS))) == [("ok",), ("invalid_argument",)]
    assert [(r["key"], r["sequence"]) for r in one.log().collect()] == [("a", 5)]


def test_a_new_store_needs_a_shard_count_and_is_empty(spark, store, tmp_path):
    assert store.live().count() == 0 and store.verify().count() == 0
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/none")
