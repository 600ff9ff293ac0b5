"""Seeded benchmark workloads: key choosers over a number of keys, the same rows for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZIPF_EXPONENT = 1.2


def _uniform(seed: int) -> Column:
    """A number in [0, 1) from the row and the seed, whatever the partitioning."""
    return F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def _owner(workers: int, seed: int) -> Column:
    """A worker drawn with weights 1 / (w + 1) ^ 1.2."""
    weights = [1 / (w + 1) ** ZIPF_EXPONENT for w in range(workers)]
    u, run, out = _uniform(seed) * sum(weights), 0.0, F.lit(workers - 1)
    for w in reversed(range(workers - 1)):
        run = sum(weights[: w + 1])
        out = F.when(u < run, w).otherwise(out)
    return out


def operations(spark: SparkSession, n: int, keys: int, workers: int, chooser: str, seed: int = 0, key_bytes: int = 16) -> DataFrame:
    """``(i, worker, key)`` of n operations: sequential, uniform, affine, single or zipf (skews the worker, not the key).

    With affine, single and zipf a key belongs to the worker that its number has as remainder.
    """
    df = spark.range(n).withColumnRenamed("id", "i")
    per = max(1, keys // workers)
    at = F.floor(_uniform(seed) * keys)
    inside = F.floor(_uniform(seed + 1) * per) * workers
    worker = {"affine": F.pmod("i", F.lit(workers)), "single": F.lit(0), "zipf": _owner(workers, seed)}.get(chooser)
    number = {"sequential": F.pmod("i", F.lit(keys)), "uniform": at}.get(chooser, None if worker is None else inside + worker)
    if number is None:
        raise ValueError(f"unknown chooser {chooser}")
    df = df.withColumn("number", number.cast("long"))
    return df.select("i", F.pmod("number", F.lit(workers)).cast("int").alias("worker"), F.rpad(F.col("number").cast("string"), key_bytes, "k").alias("key"))
