"""A store over Parquet: the verbs get, put, erase, batch, flush, compact, backup and verify at table scale.

The log is a set of immutable Parquet folders named by a catalog. Each write adds a folder, then publishes a catalog row of the next
generation, with the last sequence each shard reached, so sequences go on after a compaction too; readers use the newest. A write that dies before its catalog row leaves a folder no one reads. One writer at
a time, as a store has one owner; any number of readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tidelog import schema as S
from tidelog.functions.scalars import encoded_size, expired
from tidelog.operators import audit, latest
from tidelog.operators.segments import sharded

LOG = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("opcode", T.IntegerType()), T.StructField("value", T.StringType()),
    T.StructField("expire_at_ns", T.LongType()), T.StructField("shard", T.IntegerType()),
])
CATALOG = T.StructType([
    T.StructField("generation", T.LongType()), T.StructField("shards", T.IntegerType()), T.StructField("folders", T.ArrayType(T.StringType())), T.StructField("reached", T.MapType(T.IntegerType(), T.LongType())),
])


class Store:
    """A handle of a path: it holds no data and no state but the path."""

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        if self._catalog() is None:
            if shards is None:
                raise ValueError("a new store needs a shard count")
            self._publish(1, shards, [], {})

    def _catalog(self):
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/catalog")
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return None
        return self.spark.read.schema(CATALOG).parquet(f"{self.path}/catalog").orderBy(F.desc("generation")).first()

    def _publish(self, generation: int, shards: int, folders: list[str], reached: dict[int, int]) -> None:
        self.spark.createDataFrame([(generation, shards, folders, reached)], CATALOG).coalesce(1).write.mode("append").parquet(f"{self.path}/catalog")

    def log(self) -> DataFrame:
        folders = self._catalog()["folders"]
        if not folders:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/log/{f}" for f in folders))

    def _append(self, rows: DataFrame, instead: bool = False) -> None:
        now, folder = self._catalog(), uuid.uuid4().hex
        rows.select(LOG.names).write.parquet(f"{self.path}/log/{folder}")
        made = self.spark.read.schema(LOG).parquet(f"{self.path}/log/{folder}").groupBy("shard").agg(F.max("sequence").alias("last")).collect()  # a row a shard
        reached = dict(now["reached"] or {})
        for r in made:
            reached[r["shard"]] = max(reached.get(r["shard"], 0), r["last"])
        self._publish(now["generation"] + 1, now["shards"], [folder] if instead else [*now["folders"], folder], reached)

    def _numbered(self, items: DataFrame) -> DataFrame:
        """Items ``(pos, key, ...)`` with shard and the sequences that follow each shard's last, in order of ``pos``."""
        last = self.spark.createDataFrame(list((self._catalog()["reached"] or {}).items()), "shard int, last long")
        n = F.row_number().over(W.Window.partitionBy("shard").orderBy("pos"))
        out = sharded(items, self._catalog()["shards"]).withColumn("n", n).join(last, "shard", "left")
        return out.withColumn("sequence", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("long")).drop("n", "last", "key_hash")

    def get(self, keys: DataFrame, now_ns: int = 0) -> DataFrame:
        """``(pos, key, status, value, sequence)`` of probes ``(pos, key)``."""
        return latest.multi_get(self.log(), keys, now_ns)

    def put(self, items: DataFrame) -> DataFrame:
        """Puts ``(pos, key, value, expire_at_ns)``; returns ``(pos, status)``. A refused item spares the rest; the last of a key wins."""
        size = encoded_size(F.col("key"), F.col("value"))
        status = F.when(F.col("key").isNull() | (F.col("key") == ""), "invalid_argument").when(size > S.MAX_RECORD_BYTES, "too_large").otherwise("ok")
        judged = items.withColumn("status", status)
        self._append(self._numbered(judged.where("status = 'ok'")).withColumn("opcode", F.lit(S.PUT)).withColumn("expire_at_ns", F.coalesce("expire_at_ns", F.lit(0))))
        return judged.select("pos", "status")

    def erase(self, keys: DataFrame) -> DataFrame:
        """Erases ``(pos, key)``; returns ``(pos, status)``. An absent key writes nothing; of a repeated key only the first erase hits."""
        asked = self.log().join(keys.select("key").distinct(), "key", "left_semi")
        here = latest.index(asked).select("key", F.lit(True).alias("here"))
        first = F.row_number().over(W.Window.partitionBy("key").orderBy("pos")) == 1
        judged = keys.withColumn("first", first).join(here, "key", "left")
        judged = judged.select("pos", "key", F.when(F.col("here") & F.col("first"), "erased").otherwise("not_found").alias("status"))
        # the answer is what was true before the erases are in the log
        judged.write.parquet(place := f"{self.path}/answers/{uuid.uuid4().hex}")
        judged = self.spark.read.schema(judged.schema).parquet(place)
        self._append(self._numbered(judged.where("status = 'erased'")).withColumn("opcode", F.lit(S.ERASE)).withColumn("value", F.lit(None).cast("string")).withColumn("expire_at_ns", F.lit(0).cast("long")))
        return judged.select("pos", "status")

    def flush(self) -> int:
        """The generation that holds all writes so far. Every write is durable once it returns, so there is nothing left to force."""
        return self._catalog()["generation"]

    def live(self, now_ns: int = 0) -> DataFrame:
        return latest.live(self.log(), now_ns)

    def compact(self, now_ns: int = 0) -> None:
        """Rewrites the whole log as its visible state, sequences kept; erases go together with all they hide."""
        keep = latest.index(self.log(), "shard").where(~expired(F.col("expire_at_ns"), now_ns))
        self._append(keep, instead=True)

    def backup(self, to: str) -> DataFrame:
        """Copies the log and returns one row of counts and checksums of both sides."""
        copy = Store(self.spark, to, self._catalog()["shards"])
        copy._append(self.log(), instead=True)
        return audit.backup_verify(self.log(), copy.log(), LOG.names)

    def reshard(self, to: str, shards: int, now_ns: int = 0) -> Store:
        """A new store of the visible state under another shard count."""
        copy = Store(self.spark, to, shards)
        copy._append(sharded(self.live(now_ns), shards).withColumn("opcode", F.lit(S.PUT)))
        return copy

    def verify(self) -> DataFrame:
        """Rows that break a rule: repeated sequences of a key, wrong shards."""
        twice = latest.duplicate_sequences(self.log()).select("key", "sequence", F.lit("duplicate_sequence").alias("problem"))
        lost = audit.wrong_owner(self.log(), self._catalog()["shards"]).select("key", "sequence", F.lit("wrong_shard").alias("problem"))
        return twice.unionByName(lost)

    def stats(self, now_ns: int = 0) -> DataFrame:
        return latest.rebuild_stats(self.log(), now_ns)
