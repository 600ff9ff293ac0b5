"""Best-fit packing of token sequences by patterns fitted with non-negative least squares.

Only lengths decide a packing, and there are at most ``capacity`` of them, so the plan is made from the
length histogram whatever the size of the corpus: patterns of up to three lengths that fill a sequence
exactly are enumerated, their repeat counts fitted to the histogram by non-negative least squares and
rounded down, and what is left over is packed best-fit decreasing, on counts. A piece finds its place
by (length, rank among that length). Ranks are dealt out inside salted groups and shifted by counts.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import table

CAPACITY = 2048
#: Groups that the pieces of a length are ranked in; those of full length, which may be most, in more.
SALTS, FULL_SALTS = 64, 4096
#: From so long a run of white space on, the library's own tokenizer is used: the faster one's pattern runs out of stack.
LONG_RUN = re.compile(r"\s{100000}")
END_ID = 0
PIECES = "piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level BPE vocabulary file of ``tokenizers`` as a ``tiktoken`` encoding of the same ids.

    The ids of such a file rank its merges, so it needs nothing else; tests hold both libraries equal.
    """
    import tiktoken

    spec = json.loads(open(path, encoding="utf-8").read())
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(path: str, text: str) -> np.ndarray:
    """The ids of a text of any length, without special tokens around it."""
    if len(text) >= 100_000 and LONG_RUN.search(text):
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return encoder(path).encode_to_numpy(text, allowed_special="all")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of n ids: whole if it fits, else full pieces after a first one that may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(key, piece, start, length, ids_crc32[, ids])`` of every document: its ids, then id 0. A null text is empty: one piece of one id."""
    path = tokenizer or default_tokenizer()
    schema = f"{docs.select(key).schema[0].simpleString().replace(':', ' ')}, {PIECES}" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at, out, ids_out = [], [], []
            for i, t in enumerate(texts):
                ids = np.append(token_ids(path, t.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[s : s + n]
                    at.append(i)
                    out.append((k, s, n, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            arrays = [keys.take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(key, text).mapInArrow(run, schema)


def patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths, 0 for none, descending, that sum to ``capacity``, of lengths that occur."""
    a = np.flatnonzero(present[: capacity + 1])
    a = a[a > 0]
    found = [np.array([[capacity, 0, 0]])] if present[capacity] else []
    pair = a[(a >= capacity - a) & (a < capacity)]
    pair = pair[present[capacity - pair]]
    found.append(np.stack([pair, capacity - pair, 0 * pair], 1))
    for x in a:
        y = a[(a <= x) & (a < capacity - x)]
        z = capacity - x - y
        ok = (z <= y) & (z > 0)
        y, z = y[ok], z[ok]
        ok = present[z]
        found.append(np.stack([np.full(ok.sum(), x), y[ok], z[ok]], 1))
    return np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)


def fit(rows: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared misfit of the patterns to the histogram, by accelerated projected gradient."""
    size, flat = len(hist), rows.ravel()

    def spread(x):
        made = np.bincount(flat, np.repeat(x, rows.shape[1]), size)
        made[0] = 0
        return made

    step = 1.0 / max(1.0, _norm(rows, spread))
    x = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        r = spread(z) - hist
        r[0] = 0
        nxt = np.maximum(0.0, z - step * r[rows].sum(1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def _norm(rows: np.ndarray, spread) -> float:
    """The largest eigenvalue of A'A, from above by a few power rounds."""
    v = np.ones(len(rows))
    for _ in range(20):
        v /= np.linalg.norm(v) or 1.0
        s = spread(v)
        s[0] = 0
        v = s[rows].sum(1)
    return 1.05 * float(np.linalg.norm(v))


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)`` that together use up ``hist[length]`` exactly."""
    left = hist.astype(np.int64).copy()
    done: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        done.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rows = patterns(capacity, left > 0)
    if len(rows):
        x = np.floor(fit(rows, left.astype(float)) + 1e-6).astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            if x[k] <= 0:
                break
            lengths = tuple(int(v) for v in rows[k] if v)
            n = min(int(x[k]), *(int(left[v]) // lengths.count(v) for v in lengths))
            if n > 0:
                done.append((lengths, n))
                for v in lengths:
                    left[v] -= n
    return done + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal pieces go into equally filled sequences together."""
    open_: dict[int, list[list]] = {}
    spaces = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            fits = np.flatnonzero(spaces[length:])
            if len(fits):
                space = int(fits[0]) + length
                held, n = open_[space].pop()
                if not open_[space]:
                    spaces[space] = False
                if n > count:
                    open_.setdefault(space, []).append([held, n - count])
                    spaces[space] = True
                    n = count
            else:
                space, held = capacity, ()
                n = max(1, count // (capacity // length))
            rest = space - length
            open_.setdefault(rest, []).append([(*held, length), n])
            spaces[rest] = True
            count -= n
    return [(held, n) for group in open_.values() for held, n in group]


def places(done: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which rank on, the sequence id of that rank and the offset there."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, n in done:
        offset = 0
        for v in lengths:
            found.setdefault(v, []).append((n, base, offset))
            offset += v
        base += n
    out = {}
    for v, spans in found.items():
        n, first, offset = (np.array(c, np.int64) for c in zip(*spans, strict=True))
        out[v] = (np.cumsum(n) - n, first, offset)
    return out


def pack_pieces(made: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written pieces; every sequence is filled without gaps from 0."""
    spark = made.sparkSession
    salts = F.when(F.col("length") == capacity, FULL_SALTS).otherwise(SALTS)
    made = made.withColumn("salt", F.pmod(F.xxhash64(F.col(key).cast("string"), "piece", "ids_crc32"), salts).cast("int"))
    counts = made.groupBy("length", "salt").count().collect()  # at most capacity * SALTS + FULL_SALTS rows, whatever the corpus
    table_, full = np.zeros((capacity, SALTS), np.int64), np.zeros(FULL_SALTS, np.int64)
    for r in counts:
        if r["length"] == capacity:
            full[r["salt"]] = r["count"]
        else:
            table_[r["length"], r["salt"]] = r["count"]
    hist = np.append(table_.sum(1), full.sum())
    found = spark.sparkContext.broadcast((np.cumsum(table_, 1) - table_, np.cumsum(full) - full, places(plan(hist, capacity), capacity)))

    def run(frames):
        before, before_full, where = found.value
        for f in frames:
            length, salt = f["length"].to_numpy(), f.pop("salt").to_numpy()
            whole = length == capacity
            rank = f.pop("rank").to_numpy() + np.where(whole, before_full[salt], before[np.where(whole, 0, length), np.where(whole, 0, salt)])
            seq, off = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1))
            for lo, hi in zip(bounds, [*bounds[1:], len(f)], strict=True):
                at = order[lo:hi]
                starts, first, offset = where[int(length[at[0]])]
                j = np.searchsorted(starts, rank[at], side="right") - 1
                seq[at], off[at] = first[j] + rank[at] - starts[j], offset[j]
            yield f.assign(sequence_id=seq, offset=off)

    ranked = made.withColumn("rank", (F.row_number().over(W.Window.partitionBy("length", "salt").orderBy(key, "piece", "ids_crc32")) - 1).cast("long"))
    names = [c for c in ranked.columns if c not in ("salt", "rank")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(names).schema)
    return ranked.mapInPandas(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every row of ``docs``.

    A null or empty text is one piece, the end id. Repeated rows are packed each. A null key stays null and is
    packed like others. An empty table gives no row. Only key and text are read. Texts are tokenized whole.
    """
    return pack_pieces(table(pieces(docs, key, text, tokenizer, capacity), "pieces"), key, capacity)
