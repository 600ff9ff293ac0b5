"""Explicit schemas and the fixed values of the storage format."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the format.
SEGMENT_BYTES = 67_108_864
SEGMENT_HEADER_BYTES = 4096
RECORD_HEADER_BYTES = 56
RECORD_ALIGNMENT = 8
MAX_RECORD_BYTES = 1_048_576
MAX_FRAME_BYTES = 2_097_152
PUT, ERASE = 1, 2
MANIFEST_HEADER_BYTES, MANIFEST_ENTRY_BYTES, INTENT_HEADER_BYTES = 128, 32, 128
LATENCY_BOUNDS_NS = (1_000, 10_000, 100_000, 1_000_000, 10_000_000, 100_000_000, 1_000_000_000)
FOREGROUND_BOUNDS_NS = (1_000_000, 5_000_000, 10_000_000, 25_000_000, 50_000_000, 100_000_000, 250_000_000, 1_000_000_000)

MUTATIONS = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("opcode", T.IntegerType()),
    T.StructField("value", T.StringType()), T.StructField("expire_at_ns", T.LongType()), T.StructField("commit_ns", T.LongType()),
])
