"""Scalar rules of the store as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import schema as S


def expired(expire_at_ns: Column, now_ns: int) -> Column:
    """Set, at or before a clock that is set. Clock 0 switches expiry off."""
    return (expire_at_ns != 0) & F.lit(now_ns != 0) & (expire_at_ns <= F.lit(now_ns))


def encoded_size(key: Column, value: Column) -> Column:
    """Header, key and value bytes rounded up to the alignment; an erase has no value."""
    raw = S.RECORD_HEADER_BYTES + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))
    return (F.floor((raw + S.RECORD_ALIGNMENT - 1) / S.RECORD_ALIGNMENT) * S.RECORD_ALIGNMENT).cast("long")


def basis_points(n: Column, d: Column) -> Column:
    """floor(10000 n / d) without overflow, 0 for d = 0, at most 10000."""
    ratio = F.expr("1").cast("decimal(38,0)")  # keeps the product exact
    value = F.floor(n.cast("decimal(20,0)") * 10000 * ratio / F.when(d != 0, d.cast("decimal(20,0)")))
    return F.least(F.coalesce(value.cast("long"), F.lit(0)), F.lit(10000)).cast("int")


def ceil_percentage(total: Column, percent: int) -> Column:
    return (F.floor(total / 100) * percent + F.floor((F.pmod(total, F.lit(100)) * percent + 99) / 100)).cast("long")


def has_prefix(key: Column, prefix: Column) -> Column:
    """Bytewise prefix test; the empty prefix is in every key."""
    raw = F.encode(prefix, "utf-8")
    return F.substring(F.encode(key, "utf-8"), F.lit(1), F.length(raw)) == raw


def segment_filename(segment_id: Column, generation: Column, suffix: str) -> Column:
    return F.concat(F.lit("segment-"), F.lpad(F.lower(F.hex(segment_id)), 16, "0"), F.lit("-"), F.lpad(F.lower(F.hex(generation)), 8, "0"), F.lit(suffix))
