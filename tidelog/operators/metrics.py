"""Latency histograms and their three percentile rules, counters, benchmark summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidelog import schema as S


def _bucket(sample: Column, bounds: tuple[int, ...]) -> Column:
    """The first bucket whose bound holds the sample; the last one has no bound."""
    out = F.when(sample <= bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(sample <= b, i)
    return out.otherwise(len(bounds))


def histogram(samples: DataFrame, column: str) -> DataFrame:
    """``(bucket, bound_ns, observations, cumulative)`` for all eight buckets, empty ones too; the last bound is null."""
    counts = samples.groupBy(_bucket(F.col(column), S.LATENCY_BOUNDS_NS).alias("bucket")).agg(F.count("*").alias("n"))
    dim = samples.sparkSession.createDataFrame([*enumerate(S.LATENCY_BOUNDS_NS), (len(S.LATENCY_BOUNDS_NS), None)], "bucket int, bound_ns long")
    df = dim.join(counts, "bucket", "left").select("bucket", "bound_ns", F.coalesce("n", F.lit(0)).alias("observations"))
    return df.withColumn("cumulative", F.sum("observations").over(W.Window.orderBy("bucket")))  # eight rows


def percentiles(samples: DataFrame, column: str, ps: list[float]) -> DataFrame:
    """Interpolated inside a bucket: rank max(1, floor(n p)); the open bucket answers its lower bound, 1 s where nothing lies below."""
    h = histogram(samples, column)
    w = W.Window.orderBy("bucket")  # eight rows
    h = h.withColumn("lower", F.coalesce(F.lag("bound_ns").over(w), F.lit(0))).withColumn("before", F.coalesce(F.lag("cumulative").over(w), F.lit(0)))
    total = h.agg(F.sum("observations").alias("n"))
    ask = samples.sparkSession.createDataFrame([(p,) for p in ps], "p double").crossJoin(total)
    ask = ask.withColumn("rank", F.when(F.col("n") > 0, F.least(F.greatest(F.floor(F.col("n") * F.col("p")), F.lit(1)), F.col("n"))))
    hit = ask.join(h, (F.col("cumulative") >= F.col("rank")) & (F.col("before") < F.col("rank")), "left")  # a few by eight rows
    upper = F.coalesce("bound_ns", F.when(F.col("lower") == 0, 1_000_000_000).otherwise(F.col("lower")))
    value = F.col("lower") + F.expr("0") + F.floor(F.greatest(upper - F.col("lower"), F.lit(0)).cast("decimal(20,0)") * (F.col("rank") - F.col("before")) / F.col("observations"))
    return hit.select("p", F.coalesce(value.cast("long"), F.lit(0)).alias("value_ns"))


def foreground_p99(samples: DataFrame, column: str) -> DataFrame:
    """The upper bound of the bucket at rank n - n div 100 of nine buckets; null for the open one, 0 without samples."""
    bounds = S.FOREGROUND_BOUNDS_NS
    counts = samples.groupBy(_bucket(F.col(column), bounds).alias("bucket")).agg(F.count("*").alias("n"))
    w = W.Window.orderBy("bucket")  # at most nine rows
    df = counts.withColumn("c", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.Window.partitionBy(F.lit(0))))
    hit = df.where(F.col("c") >= F.col("all") - F.floor(F.col("all") / 100)).agg(F.min("bucket").alias("bucket"), F.coalesce(F.max("all"), F.lit(0)).alias("samples"))
    bound = F.element_at(F.array(*(F.lit(b).cast("long") for b in (*bounds, None))), F.col("bucket") + 1)
    return hit.select("samples", F.when(F.col("bucket").isNull(), 0).otherwise(bound).alias("p99_ns"))


def stats_report(counters: DataFrame) -> DataFrame:
    """Last, total and maximum of each counter ``(name, at, value)`` as ``(name, value)`` rows."""
    df = counters.groupBy("name").agg(F.max_by("value", "at").alias("last"), F.sum("value").alias("total"), F.max("value").alias("maximum"))
    return df.selectExpr("stack(3, concat(name, '_last'), last, concat(name, '_total'), total, concat(name, '_max'), maximum) AS (name, value)")


def bench_summary(samples: DataFrame, group: str, column: str) -> DataFrame:
    """Median (mean of the middle two) and nearest-rank tails by group."""
    return samples.groupBy(group).agg(
        F.count("*").alias("n"), F.median(column).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})").alias("p95"),
        F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY {column})").alias("p99"),
    )
