"""Plans: what must reach the scan, what must not be shuffled, and what a skewed key does."""

from pyspark.sql import functions as F

from tidelog.operators import latest
from tidelog.plans.queries import QUERIES
from tidelog.sources import logs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_key_filter_goes_below_the_aggregate_and_others_stay_above(spark, sf_dir):
    df = latest.live(logs.event_log(spark, sf_dir), 0).where(F.col("key") == "user:7")
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "Aggregate" in line)
    above, below = "\n".join(x for x in lines[:at] if "Filter" in x), "\n".join(x for x in lines[at + 1 :] if "Filter" in x)
    assert "opcode" in above and "user:7" not in above
    assert "user:7" in below and "opcode" not in below


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(latest.live(logs.event_log(spark, sf_dir), 0))
    schema = text[text.index("ReadSchema") :]
    assert "value:double" not in schema


def test_latest_has_one_shuffle_with_a_partial_aggregate(spark, sf_dir):
    text = plan(QUERIES["live_snapshot_orders"](spark, sf_dir))
    assert text.count("Exchange") == 1 and "partial_max_by" in text


def test_a_key_with_a_third_of_the_log_sends_one_row_per_task(spark):
    n = 30_000
    df = spark.range(n, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"), (F.col("id") + 1).alias("sequence"), F.lit(1).alias("opcode"), F.lit("v").alias("value"),
        F.lit(0).cast("long").alias("expire_at_ns"),
    )
    out = latest.live(df, 0)
    assert out.count() == 2 * n // 3 + 1
    assert out.where("key = 'hot'").first()["sequence"] == n - 2
