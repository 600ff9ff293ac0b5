"""Golden values of the hashes and of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import hashing as H
from tidelog.functions import scalars as C

GOLDEN = {
    b"": ("cbf29ce484222325", 1, 5, "9bdcbb42a87f709e"), b"alpha": ("8ac625bb85ed202b", 3, 3, "cbcb08772a9a39d6"), b"user:1": ("f7fd9aaa75081ceb", 3, 3, "f090937383b72470"),
    b"user:150": ("5f32192329a127fe", 2, 6, "de82ffaaa67e89a2"), b"part:1": ("e8f8e3d83b7ebda1", 1, 1, "bcb4a590b3db8c86"), b"tenant-a/orders/1": ("e065ac713347597d", 1, 5, "712fcec57ac84546"),
    b"\x00k\xff": ("d8ba37186b91cd79", 1, 1, "1f2e0f4ce3b96b2a"),
}


def test_hashes(spark):
    df = spark.createDataFrame([(bytearray(k),) for k in [*GOLDEN, b"123456789"]], "k binary")
    df = df.select("k", H.fnv1a_hex("k").alias("f"), H.siphash_hex(F.col("k"), 0x1111222233334444).alias("s"), H.crc32c_hex("k").alias("c"))
    df = df.select("*", H.remainder(F.col("f"), 4).alias("m4"), H.remainder(F.col("f"), 8).alias("m8"))
    got = {bytes(r["k"]): r for r in df.collect()}
    for k, (f, m4, m8, s) in GOLDEN.items():
        assert (got[k]["f"], got[k]["m4"], got[k]["m8"], got[k]["s"]) == (f, m4, m8, s)
    assert got[b"123456789"]["c"] == "e3069283"


def test_hash_of_null_is_null(spark):
    r = spark.createDataFrame([(None,), ("a",)], "k string").select(H.fnv1a_hex("k").alias("f")).collect()
    assert sorted((x["f"] is None) for x in r) == [False, True]


@pytest.mark.parametrize(("n", "d", "bp"), [(0, 0, 0), (1, 3, 3333), (5, 5, 10000), (9, 5, 10000), (2**62, 2**62, 10000)])
def test_basis_points(spark, n, d, bp):
    df = spark.createDataFrame([(n, d)], "n long, d long")
    assert df.select(C.basis_points(F.col("n"), F.col("d"))).first()[0] == bp


def test_encoded_size_and_prefix(spark):
    df = spark.createDataFrame([("", None, ""), ("k", "v", "k"), ("abcd", "1234", "abcde"), ("é", None, "é")], "k string, v string, p string")
    got = [tuple(r) for r in df.select(C.encoded_size(F.col("k"), F.col("v")), C.has_prefix(F.col("k"), F.col("p"))).collect()]
    assert got == [(56, True), (64, True), (64, False), (64, True)]
