"""The log as a stream: continuous latest-wins state, and keyed state with lazy expiry. Each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelog import schema as S


def latest_stream(mutations: DataFrame) -> DataFrame:
    """A streaming aggregate of the newest version per key; late rows have lower sequences and change nothing."""
    return mutations.groupBy("key").agg(F.max_by(F.struct("opcode", "value", "sequence", "expire_at_ns"), "sequence").alias("l")).select("key", "l.*")


class LazyExpiry(StatefulProcessor):
    """The newest version of a key with its expiry in the state, and what each mutation found: put, erased, not_found or stale.

    Expiry is judged by the mutation's own clock, never by processing time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("current", "sequence long, opcode int, expire_at_ns long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values("sequence")
        sequence, opcode, expire = self.now.get() if self.now.exists() else (0, S.ERASE, 0)
        out = []
        for r in batch.itertuples():
            if r.sequence <= sequence:
                out.append((key[0], r.sequence, "stale"))
                continue
            gone = opcode == S.ERASE or (expire != 0 and expire <= r.commit_ns)
            out.append((key[0], r.sequence, "put" if r.opcode == S.PUT else "not_found" if gone else "erased"))
            sequence, opcode, expire = int(r.sequence), int(r.opcode), int(r.expire_at_ns)
        self.now.update((sequence, opcode, expire))
        yield pd.DataFrame(out, columns=["key", "sequence", "outcome"])

    def close(self) -> None:
        pass


def outcome_stream(mutations: DataFrame) -> DataFrame:
    out = "key string, sequence long, outcome string"
    return mutations.groupBy("key").transformWithStateInPandas(statefulProcessor=LazyExpiry(), outputStructType=out, outputMode="append", timeMode="none")


def run_available(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there, with its checkpoint in the shared folder, and reads the result table."""
    from tidelog.streaming.folders import scratch

    place = scratch(spark, "stream")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    if mode == "complete":  # each batch is the whole result: a folder of its own, the last one counts
        query = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{place}/out/{i}")).option("checkpointLocation", f"{place}/state").start()
    else:
        query = writer.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if mode != "complete":
        return spark.read.schema(stream.schema).parquet(f"{place}/out")
    last = query.lastProgress
    if last is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{place}/out/{last['batchId']}")
