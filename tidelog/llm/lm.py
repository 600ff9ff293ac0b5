"""Language-model scoring by deleted interpolation.

A token's probability mixes maximum-likelihood estimates, bigram, unigram and uniform, with weights for
each bucket of the context's frequency. The weights are learned by expectation-maximisation on a
held-out part of the training documents, whose counts are deleted from the estimates meanwhile.

Counting and looking up is request and reply. Documents are dealt by key into blocks, which travel
compressed. A block asks for its distinct n-grams, sorted and packed by bucket, with its own counts; a
bucket adds up all blocks and answers each in the order it was asked. So n-grams are
combined before the shuffle, no vocabulary is ever collected or broadcast, and what is gathered grows with the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import table

#: Documents of this remainder are never learned from; those of the other one weigh the estimates.
FOLDS, TEST_FOLD, WEIGHT_FOLD = 7, 2, 6
END, BEGIN = K.U(0xE4D0E4D0E4D0E4D1), K.U(0xBE61BE61BE61BE61)
#: Steps of the histograms per natural log, the greatest code, and context buckets (powers of two).
STEPS, CODES, BUCKETS = 8, 255, 32
#: Text of a block.
BLOCK_BYTES = 8_000_000


def fold(key) -> int:
    """The remainder of a key's checksum, -1 for a null key."""
    return -1 if key is None else zlib.crc32(str(key).encode()) % FOLDS


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, compressed: small numbers cost little."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(1).compress(raw)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).reshape(-1).view(k))
        at += n * w
    return out


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """``(block, blob)``: the rows of ``docs(doc_id, text)`` by block. Weighing documents have blocks of their own, from ``blocks`` on."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            out = ([], [])
            for b, rows in held.items():
                t = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.large_binary())})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema) as w:
                    w.write_table(t)
                out[0].append(b)
                out[1].append(zstandard.ZstdCompressor(3).compress(sink.getvalue()))
                if sum(map(len, out[1])) > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["block", "blob"])
                    out = ([], [])
            held.clear()
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["block", "blob"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_binary())
            for i, key in enumerate(ids):
                t = texts[i].as_py() or b""
                f = fold(key)
                # the text takes part, so that rows without a key are spread
                h = zlib.crc32(t[:64], zlib.crc32(b"" if key is None else b"%d" % key))
                b = blocks + h % max(1, blocks // FOLDS) if f == WEIGHT_FOLD else h % blocks
                held.setdefault(b, []).append((key, t))
                size += len(t)
                if size > 32_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, "block int, blob binary")


class Block:
    """Token streams of the documents of a block: each document's words, then the end."""

    def __init__(self, blobs: list[bytes]):
        parts = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(b)).read_all() for b in blobs]
        # in one order whatever the order of arrival: equal rows are alike
        t = pa.concat_tables(parts).combine_chunks()
        self.ids = t.column(0).to_pylist()
        text = t.column(1)
        text = text.chunk(0) if text.num_chunks else pa.array([], pa.large_binary())
        tokens, counts = [], []
        offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + 2_000_000, side="right")) - 1)
            w = K.tokenize(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], lower=True)
            tokens.append(np.insert(w.hashes, w.first[1:], END))
            counts.append(w.counts() + 1)
            at = to
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, K.U)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.fold = np.array([fold(k) for k in self.ids], np.int64)
        self.before = np.r_[self.tokens[:1], self.tokens[:-1]]
        self.before[self.first] = BEGIN
        self.pairs = K._pair(self.before, self.tokens)

    def asked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For unigrams and bigrams: the distinct keys, sorted, and where each token's is. Contexts are among the unigrams, but the begin."""
        return [np.unique(x, return_inverse=True) for x in (self.tokens, self.pairs)]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys, so each holds a stretch of a sorted list."""
    return (keys >> K.U(64 - (buckets.bit_length() - 1))).astype(np.int64)


def _by_key(batches, names: int):
    """Consecutive rows of one value of the first column: ``(value, lists of the other columns)``."""
    at, held = None, None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if row[0] != at:
                if held is not None:
                    yield at, held
                at, held = row[0], [[] for _ in range(names)]
            for h, v in zip(held, row[1:], strict=True):
                h.append(v)
    if held is not None:
        yield at, held


def _requests(buckets: int):
    def run(batches):
        for block, (blobs,) in _by_key(batches, 1):
            b = Block(blobs)
            train = np.repeat((b.fold >= 0) & (b.fold != TEST_FOLD), b.counts)
            weigh = np.repeat(b.fold == WEIGHT_FOLD, b.counts)
            for kind, (keys, at) in enumerate(b.asked()):
                n = np.bincount(at, train, len(keys)).astype(np.uint32)
                m = np.bincount(at, weigh, len(keys)).astype(np.uint32)
                edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                out = ([], [], [], [])
                for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    if y > x:
                        delta = np.diff(keys[x:y], prepend=K.U(0))
                        for c, v in zip(out, (k, kind, block, _pack(delta, n[x:y], m[x:y])), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "block", "blob"])

    return run


def _replies(batches):
    """Counts over all blocks, in the order each block asked; rows of block -1 have the totals of a bucket."""
    names, kinds = ["block", "kind", "bucket", "blob"], (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    for bucket, (kind, block, blobs) in _by_key(batches, 3):
        for k in (0, 1):
            mine = [(b, *_unpack(x, "<u8", "<u4", "<u4")) for kk, b, x in zip(kind, block, blobs, strict=True) if kk == k]
            if not mine:
                continue
            keys = np.concatenate([np.cumsum(d, dtype=K.U) for _, d, _, _ in mine])
            _, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, np.concatenate([x[2] for x in mine]))
            m = np.bincount(at, np.concatenate([x[3] for x in mine]))
            out, lo = ([], [], [], []), 0
            for b, d, _, _ in mine:
                sel = at[lo : lo + len(d)]
                lo += len(d)
                for c, v in zip(out, (b, k, bucket, _pack(n[sel].astype("<u8"), m[sel].astype("<u8"))), strict=True):
                    c.append(v)
            if k == 0:
                totals = np.array([n.sum(), (n > 0).sum(), m.sum()], np.int64)
                for c, v in zip(out, (-1, 0, bucket, totals.tobytes()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)


def _answered(block: Block, kind: list[int], bucket: list[int], blobs: list[bytes]):
    """For each token: counts of itself, its pair and its context, in all training and in its weighing part. Begin contexts have -1."""
    found = []
    asked = block.asked()
    for k, (keys, _) in enumerate(asked):
        parts = sorted((b, x) for kk, b, x in zip(kind, bucket, blobs, strict=True) if kk == k)
        cols = [_unpack(x, "<u8", "<u8") for _, x in parts]
        found.append([np.concatenate([c[j] for c in cols]).astype(np.int64) if cols else np.zeros(len(keys), np.int64) for j in (0, 1)])
    uni, pair = asked[0][1], asked[1][1]
    out = []
    for j in (0, 1):
        one, two = found[0][j][uni], found[1][j][pair]
        context = np.r_[one[:1], one[:-1]]
        context[block.first] = -1
        out.append((one, two, context))
    return out


def _parts(one, two, context, total, begins):
    """Context bucket, bigram and unigram estimates."""
    context = np.where(context < 0, begins, context)
    b = np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)
    return b, two / np.maximum(context, 1), one / max(total, 1)


def _code(f: np.ndarray) -> np.ndarray:
    """0 for a zero estimate, else a step of its log from 1 on."""
    return np.where(f > 0, np.clip(np.rint(-np.log(np.maximum(f, 1e-300)) * STEPS), 0, CODES - 1) + 1, 0).astype(np.int64)


def learn(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights ``[bucket, (bigram, unigram, uniform)]`` by expectation-maximisation on a histogram of estimate pairs.

    Buckets are drawn to the weights of all together, as if by 50 more tokens.
    """
    if not cells:
        return np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    c = np.array(cells, np.float64)
    b, n = c[:, 0].astype(int), c[:, 3]
    f = np.stack([np.where(c[:, j] > 0, np.exp(-(c[:, j] - 1) / STEPS), 0) for j in (1, 2)] + [np.full(len(c), uniform)], 1)

    def fit(groups, size, prior, strength):
        w = np.tile(prior, (size, 1))
        for _ in range(rounds):
            share = w[groups] * f
            share *= (n / share.sum(1))[:, None]
            w = np.stack([np.bincount(groups, share[:, j], size) for j in range(3)], 1) + strength * prior
            w /= w.sum(1, keepdims=True)
        return w

    pooled = fit(np.zeros(len(c), int), 1, np.array([0.4, 0.4, 0.2]), 1.0)[0]
    return fit(b, BUCKETS, pooled, 50.0)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Tokens are words in lower case (A-Z), then one end. Documents of fold TEST_FOLD are held out. A null text is
    empty: its only token is the end. Rows with a null key are scored, not learned from and not held out. Repeated
    rows count each. An empty table gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    row = src.agg(F.count_if(learned != TEST_FOLD).alias("a"), F.count_if(learned == WEIGHT_FOLD).alias("b"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    begins, begins_weighing = row["a"], row["b"]
    # blocks and buckets follow the size of the corpus, so the strings between them stay worth sending
    blocks = max(FOLDS, -(-row["size"] // BLOCK_BYTES))
    buckets = 1 << min(24, max(5, (blocks - 1).bit_length()))
    sent = dealt(src, blocks).repartition("block").sortWithinPartitions("block", F.xxhash64("blob"))
    asked = sent.mapInArrow(_requests(buckets), "bucket int, kind int, block int, blob binary")
    replies = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_replies, "block int, kind int, bucket int, blob binary")
    replies = table(replies, "replies")
    totals = [np.frombuffer(r["blob"], np.int64) for r in replies.where("block = -1").select("blob").collect()]  # one row a bucket
    total, distinct, weighing = (int(sum(t[j] for t in totals)) for j in range(3))
    uniform = 1.0 / (distinct + 1)

    def weigh(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        cells = np.zeros((0, 4), np.int64)
        if left.num_rows:
            b = Block(_ordered(left))
            (one, two, ctx), (one6, two6, ctx6) = _answered(b, *(right.column(c).to_pylist() for c in ("kind", "bucket", "blob")))
            ctx = np.where(ctx < 0, -1, ctx - ctx6)
            bucket, f2, f1 = _parts(one - one6, two - two6, ctx, total - weighing, begins - begins_weighing)
            code = (bucket * (CODES + 1) + _code(f2)) * (CODES + 1) + _code(f1)
            got, n = np.unique(code, return_counts=True)
            cells = np.stack([got // (CODES + 1) ** 2, got // (CODES + 1) % (CODES + 1), got % (CODES + 1), n], 1)
        return pa.table({c: pa.array(cells[:, j], pa.int64()) for j, c in enumerate(("b", "q2", "q1", "n"))})

    own = dealt(src.where(learned == WEIGHT_FOLD), blocks)
    hist = own.groupBy("block").cogroup(replies.where(F.col("block") >= blocks).groupBy("block")).applyInArrow(weigh, "b long, q2 long, q1 long, n long")
    cells = [tuple(r) for r in hist.groupBy("b", "q2", "q1").agg(F.sum("n").alias("n")).collect()]  # bounded: buckets x codes x codes
    weights = learn(sorted(cells), uniform)

    def final(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        if not left.num_rows:
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        b = Block(_ordered(left))
        (one, two, ctx), _ = _answered(b, *(right.column(c).to_pylist() for c in ("kind", "bucket", "blob")))
        base = np.log10((one + 1) / (total + 1 * (distinct + 1)))
        bucket, f2, f1 = _parts(one, two, ctx, total, begins)
        w = weights[bucket]
        logp = np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] * uniform)
        cols = [b.ids, b.fold == TEST_FOLD, b.counts, np.add.reduceat((one > 0).astype(np.int64), b.first), np.full(len(b.ids), total), np.add.reduceat(base, b.first), np.add.reduceat(logp, b.first)]
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(names.items(), cols, strict=True)})

    scored = dealt(src, blocks).groupBy("block").cogroup(replies.where("block >= 0").groupBy("block"))
    return scored.applyInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _ordered(t: pa.Table) -> list[bytes]:
    return t.column("blob").to_pylist()
