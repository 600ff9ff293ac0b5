"""Adapters that read Parquet tables as mutation logs.

A log is ``(key, sequence, opcode, value, expire_at_ns, commit_ns)``: keyed, sequenced puts and erases. The sequence is a
global order where the table has one, else an order within the key, which is all that latest-wins needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidelog import schema as S

VIEW_TTL_NS, CLICK_TTL_NS = 3_600_000_000_000, 86_400_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanoseconds(ts: str):
    """Nanoseconds since the epoch of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))") * 1000


def events_as_log(events: DataFrame) -> DataFrame:
    """Events by user: an error erases, everything else puts; views and clicks expire."""
    commit = nanoseconds("ts")
    ttl = F.when(F.col("event_type") == "view", F.col("commit_ns") + VIEW_TTL_NS).when(F.col("event_type") == "click", F.col("commit_ns") + CLICK_TTL_NS).otherwise(0)
    return events.select("user_id", "event_id", "event_type", "props", commit.alias("commit_ns")).select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), (F.col("event_id") + 1).alias("sequence"),
        F.when(F.col("event_type") == "error", S.ERASE).otherwise(S.PUT).alias("opcode"), F.when(F.col("event_type") != "error", F.col("props")).alias("value"),
        ttl.cast("long").alias("expire_at_ns"), "commit_ns", "user_id",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_log(read(spark, sf_dir, "events"))


def part_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by part, in shipping order."""
    order = W.Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return li.select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("key"), F.row_number().over(order).cast("long").alias("sequence"), F.lit(S.PUT).alias("opcode"),
        F.col("l_returnflag").alias("value"), F.lit(0).cast("long").alias("expire_at_ns"), F.lit(0).cast("long").alias("commit_ns"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), (F.col("o_orderkey") + 1).alias("sequence"), F.lit(S.PUT).alias("opcode"),
        F.col("o_orderstatus").alias("value"), F.lit(0).cast("long").alias("expire_at_ns"), F.lit(0).cast("long").alias("commit_ns"),
    )


def clock(log: DataFrame) -> int:
    """One clock sample for a whole query: the latest commit."""
    return log.agg(F.coalesce(F.max("commit_ns"), F.lit(0))).first()[0]
