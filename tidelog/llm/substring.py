"""Substring deduplication by super-k-mer partitioning.

A window is ``k`` consecutive words of a document. Its minimiser is the least hash among its runs of
``m`` words. Consecutive windows that share a minimiser form a super-k-mer and travel as one packed
string, their words joined by a space, to the bucket of the minimiser, where all windows of the bucket
are sorted and equal ones find the smallest document that starts them.

What keeps this linear and small:

* Only super-k-mers whose minimiser occurs in two documents or more travel: the others hold no window
  of two documents. A Bloom filter tells them, which grows with the input up to a bound; it has no false
  negatives, and when full it lets more strings through, never fewer.
* Minimisers that occur very often come last in the order, so windows around a common passage are
  spread by their rarer words. The list of those is bounded.
* Equal super-k-mers are combined in each task before the shuffle, keeping the smallest document, so
  thousands of copies send one string per task. Occurrences get their answer by an equi-join on the
  string's hash, whose skewed side can be split.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import partitions, size_hint, table

WINDOW, MMER = 50, 10
#: Bits of the Bloom filter: one for so many bytes of input, within these powers of two (32 MB at most).
BYTES_A_BIT, LEAST_BITS, MOST_BITS = 4, 18, 28
#: A minimiser that occurs this often counts as common; so many are listed at most.
COMMON, MOST_COMMON = 500, 1 << 18
FLUSH = 1_000_000


class Runs:
    """Super-k-mers of a chunk: minimiser, content hash, row, first window in the row, windows, word span."""

    def __init__(self, w: K.Words, k: int, m: int, common: np.ndarray):
        n = len(w.hashes) - k + 1
        self.words = w
        if n <= 0:
            self.min = self.content = self.check = np.zeros(0, K.U)
            self.row = self.at = self.size = np.zeros(0, np.int64)
            return
        order = K.long_grams(w.hashes, m)
        if len(common):
            j = np.minimum(np.searchsorted(common, order >> K.U(1)), len(common) - 1)
            order = (order >> K.U(1)) | ((common[j] == order >> K.U(1)).astype(K.U) << K.U(63))
        else:
            order = order >> K.U(1)
        least, whole = K.slide_min(order, k - m + 1), K.long_grams(w.hashes, k)
        rows = w.rows()[:n]
        at = np.flatnonzero(np.arange(n) + k <= w.first[1:][rows])
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])
        # no run is longer than its two outer windows cover together
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        parts = -(-size // k)
        begin = np.repeat(begin, parts) + k * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        size = np.diff(np.append(begin, len(at)))
        first = at[begin] if len(at) else at
        self.min, self.row, self.size = least[first], rows[first], size
        self.at = first - w.first[self.row]
        # two hashes of the outer windows and the count: strings are told apart by both
        outer, count = (whole[first], whole[first + size - 1]), size.astype(K.U)
        with np.errstate(over="ignore"):
            self.content, self.check = K._pair(outer[0], outer[1] + count), K._pair(K.mix(outer[1]), outer[0] - count)

    def strings(self, which: np.ndarray, k: int) -> list[bytes]:
        w = self.words
        first = w.first[self.row[which]] + self.at[which]
        last = first + self.size[which] + k - 2
        lo, hi, data = w.starts[first], w.starts[last] + w.lengths[last], w.data.tobytes()
        return [b" ".join(data[a:b].split()) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def _runs(batches, k: int, m: int, common: np.ndarray):
    """Per chunk: its super-k-mers and their document ids; rows with a null id have none."""
    for part, data, offs in K.chunks(batches, 1):
        r = Runs(K.tokenize(data, offs), k, m, common)
        ids = part.column(0)
        if ids.null_count:
            ok = ids.is_valid().to_numpy(zero_copy_only=False)[r.row]
            for name in ("min", "content", "check", "row", "at", "size"):
                setattr(r, name, getattr(r, name)[ok])
            ids = ids.fill_null(0)
        yield r, ids.to_numpy(zero_copy_only=False)[r.row]


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where any of some parallel sorted keys differs from the row before; the first row does."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def filter_bits(size: int) -> int:
    """The power of two of a filter's bits for an input of so many bytes."""
    return min(MOST_BITS, max(LEAST_BITS, (size // BYTES_A_BIT).bit_length()))


class Shared:
    """The Bloom filter of minimisers of two documents or more, in one segment per bucket."""

    def __init__(self, segments: dict[int, bytes], buckets: int, bits: int):
        self.bits = bits - (buckets.bit_length() - 1)
        self.data = np.zeros((buckets, 1 << (self.bits - 3)), np.uint8)
        for b, z in segments.items():
            self.data[b] = np.frombuffer(zlib.decompress(z), np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        bucket, flat = bucket_of(keys, len(self.data)).astype(np.int64), self.data.reshape(-1)
        found = np.ones(len(keys), bool)
        for s in K.Bloom(self.bits, self.data[0])._spots(K.mix(keys)):
            found &= (flat[(bucket << (self.bits - 3)) + (s >> K.U(3)).astype(np.int64)] >> (s & K.U(7)).astype(np.uint8)) & 1 == 1
        return found


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return K.mix(keys ^ K.U(0xB0C4E7)) >> K.U(65 - buckets.bit_length())


def shared_minimisers(docs: DataFrame, k: int, m: int, common: np.ndarray, buckets: int, filter_: int):
    """One pass: Bloom segments by bucket, and the commonest minimisers."""

    def send(batches):
        kept: list[list[np.ndarray]] = []

        def flush():
            if not kept:
                return
            key, doc = (np.concatenate(c) for c in zip(*kept, strict=True))
            kept.clear()
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lo, hi, n = np.minimum.reduceat(doc, cut), np.maximum.reduceat(doc, cut), np.diff(np.r_[cut, len(key)])
            key = key[cut]
            bucket = bucket_of(key, buckets).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(bucket[by]) > 0])
            out = ([], [])
            for a, b in zip(edges, [*edges[1:], len(by)], strict=True):
                at = by[a:b]
                out[0].append(int(bucket[at[0]]))
                out[1].append(np.concatenate([key[at].view(np.int64), lo[at], hi[at] - lo[at], n[at]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["bucket", "blob"])

        held = 0
        for r, doc in _runs(batches, k, m, common):
            if len(r.min):
                kept.append([r.min, doc])
                held += len(doc)
            if held > FLUSH:
                yield from flush()
                held = 0
        yield from flush()

    def meet(batches):
        bits, most = filter_ - (buckets.bit_length() - 1), max(1, MOST_COMMON // buckets)

        def close(bucket, blobs):
            key, lo, gap, n = (np.concatenate(c) for c in zip(*(np.frombuffer(x, np.int64).reshape(4, -1) for x in blobs), strict=True))
            order = np.argsort(key, kind="stable")
            key, lo, hi, n = key[order], lo[order], (lo + gap)[order], n[order]
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, lo, hi, n = K.unsigned(key[cut]), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.add.reduceat(n, cut)
            bloom = K.Bloom(bits)
            bloom.add(K.mix(key[lo < hi]))
            often = np.flatnonzero((n > COMMON) & (lo < hi))
            often = often[np.argsort(-n[often], kind="stable")][:most]
            return [bucket], [zlib.compress(bloom.data.tobytes(), 1)], [key[often].tobytes()]

        at, blobs = None, []
        names = ["bucket", "bloom", "common"]
        kinds = (pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != at and blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(close(at, blobs), kinds, strict=True)], names)
                    blobs = []
                at = b
                blobs.append(x)
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(close(at, blobs), kinds, strict=True)], names)

    sent = docs.mapInArrow(send, "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    rows = sent.mapInArrow(meet, "bucket int, bloom binary, common binary").collect()  # 2^MOST_BITS bits and MOST_COMMON keys at most
    often = np.concatenate([np.zeros(0, K.U), *(np.frombuffer(r["common"], K.U) for r in rows)])
    return {r["bucket"]: r["bloom"] for r in rows}, often


def repeated_ranges(docs: DataFrame, k: int = WINDOW, m: int = MMER) -> DataFrame:
    """``(doc_id, ranges)``: word ranges [start, end) covered by windows that a smaller document starts too."""
    spark = docs.sparkSession
    buckets = 1 << max(6, (partitions(spark) - 1).bit_length())
    bits = filter_bits(size_hint(docs))
    buckets = min(buckets, 1 << (bits - 8))
    segments, common = shared_minimisers(docs, k, m, np.zeros(0, K.U), buckets, bits)
    if len(common):
        common = np.unique(common & K.U((1 << 63) - 1))
        segments, _ = shared_minimisers(docs, k, m, common, buckets, bits)
    held = spark.sparkContext.broadcast((segments, common))

    def wanted(batches):
        segs, often = held.value
        bloom = Shared(segs, buckets, bits)
        for r, doc in _runs(batches, k, m, often):
            which = np.flatnonzero(bloom.has(r.min))
            yield r, doc, which

    def strings(batches):
        kept: list[tuple] = []
        held_bytes = 0

        def flush():
            if not kept:
                return
            low, content, check, doc, n, text = (np.concatenate(c) for c in zip(*kept, strict=True))
            kept.clear()
            order = np.lexsort((doc, check, content))
            content, check, doc, low, n, text = content[order], check[order], doc[order], low[order], n[order], text[order]
            cut = np.flatnonzero(_changes(content, check))
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(low[cut])), pa.array(K.signed(content[cut])), pa.array(K.signed(check[cut])), pa.array(doc[cut]), pa.array(np.add.reduceat(n, cut)), pa.array(text[cut].tolist(), pa.string())], ["minimiser", "content", "check", "doc", "n", "packed"])

        for r, doc, which in wanted(batches):
            if len(which):
                # equal strings of a chunk are packed once
                order = which[np.lexsort((doc[which], r.check[which], r.content[which]))]
                cut = np.flatnonzero(_changes(r.content[order], r.check[order]))
                one = order[cut]
                text = np.empty(len(one), object)
                text[:] = r.strings(one, k)
                kept.append((r.min[one], r.content[one], r.check[one], doc[one], np.diff(np.r_[cut, len(order)]), text))
                held_bytes += sum(map(len, text))
            if held_bytes > 24_000_000:
                yield from flush()
                held_bytes = 0
        yield from flush()

    def count(batches):
        """Windows of whole minimiser groups are sorted; each string gets the smallest document of its windows."""
        rest, rest_bytes = [], 0
        for batch in batches:
            at = 0
            low = batch.column(0).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.diff(low)) + 1
            if rest and len(low) and rest[-1].column(0)[-1].as_py() != int(low[0]):
                if rest_bytes > 4_000_000:
                    yield from _owners(rest, k)
                    rest, rest_bytes = [], 0
            for e in ends[:: max(1, len(ends) // 8)] if len(ends) else []:
                rest.append(batch.slice(at, e - at))
                rest_bytes += rest[-1].nbytes
                at = int(e)
                if rest_bytes > 4_000_000:
                    yield from _owners(rest, k)
                    rest, rest_bytes = [], 0
            if at < batch.num_rows:
                rest.append(batch.slice(at))
                rest_bytes += rest[-1].nbytes
        if rest:
            yield from _owners(rest, k)

    def places(batches):
        for r, doc, which in wanted(batches):
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(r.content[which])), pa.array(K.signed(r.check[which])), pa.array(doc[which]), pa.array(r.at[which])], ["content", "check", "doc_id", "at"])

    sent = docs.mapInArrow(strings, "minimiser long, content long, check long, doc long, n long, packed string").repartition("minimiser").sortWithinPartitions("minimiser", "content", "check", "doc")
    owners = sent.mapInArrow(count, "content long, check long, runs array<struct<o:int,n:int,owner:long>>")
    owners = table(owners, "owners")
    hits = docs.mapInArrow(places, "content long, check long, doc_id long, at long").join(owners, ["content", "check"]).select("doc_id", "at", F.explode("runs").alias("r")).where("r.owner < doc_id")
    return hits.groupBy("doc_id").agg(F.collect_set(F.struct((F.col("at") + F.col("r.o")).alias("s"), (F.col("at") + F.col("r.o") + F.col("r.n") + k - 1).alias("e"))).alias("ranges"))


def _owners(batches: list[pa.RecordBatch], k: int):
    t = pa.Table.from_batches(batches).combine_chunks()
    content, check, doc, n = (t.column(i).to_numpy() for i in (1, 2, 3, 4))
    data, offs = K.buffers(t.column(5).chunk(0) if t.num_rows else pa.array([], pa.string()))
    w = K.tokenize(data, offs)
    windows = w.counts() - k + 1
    row = np.repeat(np.arange(len(windows)), windows)
    o = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = w.first[row] + o
    one, two = K.long_grams(w.hashes, k)[at], K.grams(w.hashes, k)[at]
    order = np.argsort(one, kind="stable")
    same = np.r_[False, (one[order][1:] == one[order][:-1])]
    if np.any(same & (two[order] != np.r_[two[order][:1], two[order][:-1]])):
        order = np.lexsort((two, one))
        same = np.r_[False, (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])]
    cut = np.flatnonzero(~same)
    owner = np.empty(len(row), np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(doc[row][order], cut), np.diff(np.r_[cut, len(row)]))
    # of equal strings one is answered, if another document could be touched by the answer
    by = np.lexsort((doc, check, content))
    lead = _changes(content[by], check[by])
    total = np.add.reduceat(n[by], np.flatnonzero(lead))
    first = by[lead]
    own = np.zeros(len(windows), bool)
    own[first] = total > 1
    touched = np.zeros(len(windows), bool)
    np.logical_or.at(touched, row, owner < doc[row])
    chosen = np.zeros(len(windows), bool)
    chosen[first] = True
    chosen &= own | touched
    sel = chosen[row]
    row, o, owner = row[sel], o[sel], owner[sel]
    if not len(row):
        return
    new = np.r_[True, (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])]
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(row)])
    heads = np.flatnonzero(np.r_[True, row[begin][1:] != row[begin][:-1]])
    runs = pa.ListArray.from_arrays(
        pa.array(np.r_[heads, len(begin)].astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(o[begin].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(owner[begin])], ["o", "n", "owner"]),
    )
    at = row[begin[heads]]
    yield pa.RecordBatch.from_arrays([pa.array(content[at]), pa.array(check[at]), runs], ["content", "check", "runs"])


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = MMER, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of every row with ``n_words, n_removed, kept_sha256, kept_text``.

    A word goes if a window that covers it starts, with the same words, in a document with a smaller key;
    windows are judged on the input. ``kept_text`` is the text itself where nothing goes, else the kept
    words joined by one space; a null text has no words and stays null. Rows with a null key lose nothing
    and take nothing; rows that share a key are equal partners, each losing what a smaller key repeats.
    Keys are whole numbers. An empty table gives no row. Result names replace columns of the same name.
    """
    made = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = repeated_ranges(src, k, m).withColumnRenamed("doc_id", "_s7_id").withColumnRenamed("ranges", "_s7_ranges")
    have = docs.select(*keep, F.col(key).cast("long").alias("_s7_key"), F.col(text).alias("_s7_text"))
    joined = have.join(ranges, F.col("_s7_key") == F.col("_s7_id"), "left").drop("_s7_key", "_s7_id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in have.select(keep).schema)

    def finish(batches):
        for batch in batches:
            n = len(keep)
            out = ([], [], [], [])
            for t, ranges in zip(batch.column(n), batch.column(n + 1), strict=True):
                t = t.as_py()
                parts = (t or "").encode("utf-8", "surrogatepass").split()
                gone, kept, body = 0, parts, t
                if ranges.is_valid:
                    mask = np.zeros(len(parts) + 1, np.int64)
                    for r in ranges.as_py():
                        mask[r["s"]] += 1
                        mask[r["e"]] -= 1
                    stay = np.cumsum(mask)[:-1] == 0
                    kept = [parts[i] for i in np.flatnonzero(stay)]
                    gone = len(parts) - len(kept)
                joined_words = b" ".join(kept)
                if gone:
                    body = joined_words.decode("utf-8", "surrogatepass")
                for c, v in zip(out, (len(parts), gone, hashlib.sha256(joined_words).hexdigest(), body), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], [*keep, *made])

    lead = fields + ", " if fields else ""
    return joined.select(*keep, "_s7_text", "_s7_ranges").mapInArrow(finish, f"{lead}n_words long, n_removed long, kept_sha256 string, kept_text string")
