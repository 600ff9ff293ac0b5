"""The queries of the ten operators and the pipeline, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, html, jaccard, lm, oracles, packing, preferences, quality, segmentation, sharding, substring


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is chosen over itself with another's last answer; mask spans as text."""
    made = preferences.format_pairs(preferences.swapped(_read(spark, sf_dir, "conversations")))

    def spans(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")

    return made.select("pair_id", "n_prompt_turns", "prompt", "chosen", spans("chosen_mask").alias("chosen_spans"), "rejected", spans("rejected_mask").alias("rejected_spans"))


def op3_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four distinct segmentations of every turn; ids as their checksum, and whether they decode to the text."""
    turns = _read(spark, sf_dir, "conversations")
    made = segmentation.decode(segmentation.encode_sampled(turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("text", F.lit("")).alias("said")), ["conv_id", "turn", "said"], k=4))
    ids = F.crc32(F.array_join("ids", " ").cast("binary"))
    return made.select("conv_id", "turn", "sample", F.size("ids").alias("n_ids"), ids.alias("ids_crc32"), "log_prob", "perturbed", "inclusion", (F.col("decoded") == F.col("said")).alias("round_trip"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"), k=5, percent=80)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"), cosine=0.93)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove(_read(spark, sf_dir, "documents"), keep=["doc_id"]).drop("kept_text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), shards=24).drop("vslot")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), capacity=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_preference_formatting": op2_preference_formatting,
    "op3_sampled_segmentation": op3_sampled_segmentation,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = oracles.ORACLES
