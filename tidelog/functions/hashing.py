"""Byte hashes and checksums Spark lacks: FNV-1a 64, SipHash-2-4, CRC32C.

Bulk forms are Arrow-batched and vectorised over all values of a batch, one byte position at a time, so a
batch costs as many numpy steps as its longest value has bytes. Hash distinct keys once and join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
# The published parameters of the functions.
MIX_FACTOR = 0x9E3779B97F4A7C15
FNV_OFFSET, FNV_PRIME = U(0xCBF29CE484222325), U(0x100000001B3)
SIP_START = (U(0x736F6D6570736575), U(0x646F72616E646F6D), U(0x6C7967656E657261), U(0x7465646279746573))
SIP_SECOND_KEY = 0x6A09E667F3BCC909
CRC32C_POLYNOMIAL = 0x82F63B78


def _bytes(values: pd.Series) -> list[bytes]:
    return [v.encode() if isinstance(v, str) else bytes(v) for v in values]


def _columns(raw: list[bytes]):
    """Values by descending length: (order, data, starts, lengths, how many reach each position)."""
    lengths = np.array([len(b) for b in raw], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
    starts = np.cumsum(lengths) - lengths
    longest = int(lengths[0]) if len(lengths) else 0
    reach = np.searchsorted(-lengths, -np.arange(longest), side="left") if longest else np.zeros(0, np.int64)
    return order, data, starts, lengths, reach


def fnv1a_batch(raw: list[bytes]) -> np.ndarray:
    order, data, starts, _, reach = _columns(raw)
    h = np.full(len(raw), FNV_OFFSET, U)
    with np.errstate(over="ignore"):
        for j, n in enumerate(reach):
            h[:n] = (h[:n] ^ data[starts[:n] + j].astype(U)) * FNV_PRIME
    out = np.empty_like(h)
    out[order] = h
    return out


def crc32c_batch(raw: list[bytes]) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), table >> 1).astype(np.uint32)
    order, data, starts, _, reach = _columns(raw)
    c = np.full(len(raw), 0xFFFFFFFF, np.uint32)
    for j, n in enumerate(reach):
        c[:n] = table[(c[:n] ^ data[starts[:n] + j]) & 0xFF] ^ (c[:n] >> 8)
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def siphash_batch(raw: list[bytes], k0: int, k1: int) -> np.ndarray:
    """SipHash-2-4 under a 128-bit key; values of equal word count go together."""
    out = np.empty(len(raw), U)
    words = np.array([len(b) // 8 + 1 for b in raw])
    with np.errstate(over="ignore"):
        for w in np.unique(words):
            at = np.flatnonzero(words == w)
            padded = b"".join(raw[i] + bytes(8 * w - 1 - len(raw[i])) + bytes([len(raw[i]) & 0xFF]) for i in at)
            m = np.frombuffer(padded, "<u8").reshape(len(at), w)
            v = [np.full(len(at), s ^ U(k), U) for s, k in zip(SIP_START, (k0, k1, k0, k1), strict=True)]

            def rounds(n: int, v=v) -> None:
                for _ in range(n):
                    v[0] = v[0] + v[1]
                    v[2] = v[2] + v[3]
                    v[1] = _rotate(v[1], 13) ^ v[0]
                    v[3] = _rotate(v[3], 16) ^ v[2]
                    v[0] = _rotate(v[0], 32) + v[3]
                    v[2] = v[2] + v[1]
                    v[3] = _rotate(v[3], 21) ^ v[0]
                    v[1] = _rotate(v[1], 17) ^ v[2]
                    v[2] = _rotate(v[2], 32)

            for j in range(w):
                v[3] ^= m[:, j]
                rounds(2)
                v[0] ^= m[:, j]
            v[2] ^= U(0xFF)
            rounds(4)
            out[at] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def _hex(h: np.ndarray, digits: int) -> pd.Series:
    return pd.Series([format(int(x), f"0{digits}x") for x in h], dtype=object)


def _over(values: pd.Series, batch, digits: int) -> pd.Series:
    out = pd.Series([None] * len(values), dtype=object)
    known = values.notna().to_numpy()
    if known.any():
        out[known] = _hex(batch(_bytes(values[known])), digits).to_numpy()
    return out


def _vectorised(values: Column | str, batch, digits: int) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _over(s, batch, digits)

    return run(values)


def fnv1a_hex(values: Column | str) -> Column:
    """FNV-1a 64 of text or bytes as 16 hex digits; null for null."""
    return _vectorised(values, fnv1a_batch, 16)


def crc32c_hex(values: Column | str) -> Column:
    """CRC32C (Castagnoli) of text or bytes as 8 hex digits; null for null."""
    return _vectorised(values, crc32c_batch, 8)


def siphash_hex(values: Column | str, seed: int) -> Column:
    """SipHash-2-4 as 16 hex digits, keyed by a seed and its xor with a fixed value."""
    return _vectorised(values, lambda raw: siphash_batch(raw, seed, seed ^ SIP_SECOND_KEY), 16)


def index_fingerprint(values: Column | str, seed: int) -> Column:
    """The index's mixed hash of text or bytes as 16 hex digits, and its seven-bit fingerprint, never 0, as two more."""
    def mixed(raw: list[bytes]) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (fnv1a_batch(raw) ^ U(seed)) * U(MIX_FACTOR)
            h = (h ^ (h >> U(33))) * U(MIX_FACTOR)
            return h ^ (h >> U(29))

    h = _vectorised(values, mixed, 16)
    low = F.conv(F.substring(h, 15, 2), 16, 10).cast("int").bitwiseAND(F.lit(127))
    return F.concat(h, F.lpad(F.lower(F.hex(F.greatest(low, F.lit(1)))), 2, "0"))


def remainder(hex64: Column, n: int) -> Column:
    """An unsigned 64-bit hash in hex modulo n, by its two halves: Spark has no unsigned long."""
    hi, lo = (F.conv(F.substring(hex64, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.pmod(F.pmod(hi, F.lit(n)) * F.lit(4294967296 % n) + F.pmod(lo, F.lit(n)), F.lit(n)).cast("int")
