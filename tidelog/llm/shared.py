"""Shared-folder tables, connected components and small session helpers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges (16 bytes each) up to which one task finds the components; more go through rounds over all executors.
FEW_EDGES = 200_000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_hint(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes of ``df``, without reading it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files are too small to be split so: below 4 MB a core by the optimizer's estimate.

    For steps that cost far more than moving their rows; larger inputs stay as the scan cuts them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size_hint(df) < cores * (4 << 20) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is chosen only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    kept = sc._jsc.sc().getCheckpointDir()
    if not kept.isEmpty():
        return kept.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return "/tmp/checkpoints"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.shared_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables of the shared folder that nothing reads any more: all that came of them is written."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t.shared_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``(a, b)`` and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``(node, root)``, root the smallest node reachable.

    Up to FEW_EDGES edges go to one task, as the plans of a round cost the driver more memory and time than these edges.
    More of them take alternating large-star and small-star rounds, each written to the shared folder. Every round leaves
    at most as many edges as nodes touch, in O(log n) rounds, and a hub is a key that is pre-aggregated
    by ``min`` before the join, whose skewed side can be split. Nodes without an edge do not occur.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = table(e, "cc")
    count = e.count()
    if not count:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if count <= FEW_EDGES:

        def run(batches):
            held = [tuple(batch.column(i).to_numpy() for i in (0, 1)) for batch in batches]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in smallest_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["node", "root"])

        made = table(e.coalesce(1).mapInArrow(run, "node long, root long"), "components")
        discard(e)
        return made
    seen = None
    for _ in range(max_rounds):
        # large-star: each node sends its larger neighbours to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small-star: each node sends itself and its smaller neighbours to the smallest of them
        down = large.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("s"))
        least = down.groupBy("n").agg(F.min("s").alias("m"))
        small = down.join(least, "n").select(F.col("m").alias("a"), F.explode(F.array("n", "s")).alias("b"))
        before, e = e, table(small.where("a <> b").distinct(), "cc")
        discard(before)
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    own = e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    made = table(roots.unionByName(own), "components")
    discard(e)
    return made


