"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets of similarity t or more share a token among the first ``n - ceil(t n) + 1`` of each, in any order
of all tokens, and more of them the larger the sets. The first order meets documents in buckets; only tokens of two
classes or more leave a bucket, as posting lists, and equal lists of a bucket are one. Pairs that share enough of
their prefixes under the first order are candidates. They meet the prefixes under the second and third order, packed
numbers of a fifth of a set, and only pairs that pass all three filters bring texts together for the
exact comparison. The filters lose nothing and all counts are exact.

Skew is met in four ways. Documents of equal sets are one class. Tokens that occur very often come last
in every order (a bounded list), so passages that many documents share make no candidates. Lists that are still long
name their tokens as common and are made again; those that stay long, as near copies of one text in thousands make, are
counted in blocks of classes. In what is left, each class is first compared with one centre, and only
classes that are still apart are paired, so a group of near copies costs a star and not all pairs. Joins on a hot
centre or list have a side that can be split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import components, discard, partitions, table

SHINGLE, PERCENT = 5, 80
#: Seeds of the token orders; the first one makes the buckets.
ORDERS = (0x0D1, 0x0D2, 0x0D3)
#: A token of so many documents is common; a posting list of so many classes is looked at anew; so many tokens are listed.
COMMON, LONG_LIST, MOST_COMMON, ROUNDS = 64, 64, 1 << 19, 2
#: Rounds of stars; pairs for each row that lists may still make before long ones give way; a later star is worth its
#: while if lists make fewer pairs than this for each class that asks.
STARS, MOST_PAIRS, FEW = 3, 4, 1000
#: Classes of a packed piece of a list.
PIECE = 64
#: Tokens of a block of classes that are compared in one place, and pairs of a place.
CELL, PAIRS = 500_000, 2048
#: Classes of a block of a group of long lists.
BLOCK = 256
FLUSH = 1_000_000
#: Bits of a filter of ids at most (16 MB), and its parts.
MOST_BITS, SEGMENTS = 27, 16


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row: under k words, the whole sequence is one; without words, none."""
    w = K.tokenize(data, offs, lower=True)
    g = K.grams(w.hashes, k)
    first = w.first.tolist()
    for a, b in zip(first, first[1:], strict=False):
        n = b - a
        if n >= k:
            yield np.unique(g[a : b - k + 1])
        elif n:
            short = np.concatenate([w.hashes[a:b], np.full(k - n, n, K.U)])
            yield K.mix(K.grams(short, k) ^ K.U(0x5407))
        else:
            yield np.zeros(0, K.U)


def set_hash(u: np.ndarray) -> int:
    """A hash of a set, by an order-free sum, as a signed long."""
    with np.errstate(over="ignore"):
        total = K.mix(u ^ K.U(0x5E7)).sum(dtype=K.U) + K.U(len(u)) * K.U(0x9E3779B97F4A7C15)
    return int(K.signed(K.mix(np.array([total], K.U)))[0])


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with a partner."""
    return -(-percent * n // 100)


def prefix(u: np.ndarray, seed: int, common: np.ndarray, shift: int, percent: int = PERCENT) -> np.ndarray:
    """The tokens of a set that come first under the order (common or not, hash mixed with the seed)."""
    p = len(u) - needed(len(u), percent) + 1
    if len(u) <= p:
        return u
    o = K.mix(u ^ K.U(seed))
    late = _listed(token_id(u, shift), common)
    front = np.flatnonzero(~late)
    if len(front) >= p:
        return u[front[np.argpartition(o[front], p - 1)[:p]]]
    back, rest = np.flatnonzero(late), p - len(front)
    return u[np.concatenate([front, back[np.argpartition(o[back], rest - 1)[:rest]]])]


def token_id(u: np.ndarray, shift: int) -> np.ndarray:
    """A token within the buckets: the bucket in the high bits, then 32 bits."""
    return K.mix(u ^ K.U(0x70C)) >> K.U(shift)


def _listed(x: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(x), bool)
    j = np.minimum(np.searchsorted(common, x), len(common) - 1)
    return common[j] == x


def classes(docs: DataFrame, shift: int, k: int) -> tuple[DataFrame, np.ndarray]:
    """``(doc_id, n, cls, mark)`` of every row, ``mark`` a hash of its text, and the ids of common tokens.

    Each task lists the tokens that occur repeatedly in a stretch of its rows; the sums over all rows
    say which are common. The list only orders tokens: any list gives the same links.
    """

    def run(batches):
        held: list[np.ndarray] = []
        total = 0

        def often():
            ids, n = np.unique(np.concatenate(held), return_counts=True)
            ids, n = ids[n >= 4], n[n >= 4]
            return pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(n), pa.array(K.signed(ids)), pa.nulls(len(ids), pa.int64())], ["doc_id", "n", "cls", "mark"])

        for part, data, offs in K.chunks(batches, 1):
            n, cls = [], []
            for u in shingle_sets(data, offs, k):
                n.append(len(u))
                cls.append(set_hash(u) if len(u) else None)
                held.append(token_id(u, shift))
                total += len(u)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([-1 - x for x in n], pa.int64()), pa.array(cls, pa.int64()), part.column(2)], ["doc_id", "n", "cls", "mark"])
            if total > FLUSH:
                yield often()
                held, total = [], 0
        if held:
            yield often()

    made = table(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, n long, cls long, mark long"), "classes")
    sums = made.where("n > 0").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
    common = np.array([r[0] for r in sums.orderBy(F.desc("n"), "cls").limit(MOST_COMMON).select("cls").collect()], np.int64)
    return made.where("n < 0").select("doc_id", (-1 - F.col("n")).alias("n"), "cls", "mark"), np.sort(K.unsigned(common))


def postings(docs: DataFrame, common: np.ndarray, buckets: int, k: int, percent: int) -> DataFrame:
    """``(list, cls, size, weight)``: prefix tokens of the first order held by two classes or more.

    Tokens of a bucket with the same classes are one list of that weight and size. Rows with a null
    ``weight`` name tokens whose lists are long.
    """
    shift = 64 - (buckets.bit_length() - 1) - 32
    held = docs.sparkSession.sparkContext.broadcast(common)

    def send(batches):
        often = held.value
        ids: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        total = 0

        def flush():
            if not ids:
                return
            cls = np.repeat(np.array([c for c, _ in owners], np.int64), [n for _, n in owners])
            tok = np.concatenate(ids)
            order = np.lexsort((cls, tok))
            tok, cls = tok[order], cls[order]
            one = np.r_[True, (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])]
            tok, cls = tok[one], cls[one]
            bucket = (tok >> K.U(32)).astype(np.int64)
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            out = ([], [])
            for a, b in zip(edges, [*edges[1:], len(tok)], strict=True):
                out[0].append(int(bucket[a]))
                out[1].append(tok[a:b].astype(np.uint32).tobytes() + cls[a:b].tobytes())
            ids.clear()
            owners.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["bucket", "blob"])

        seen: set[int] = set()
        for part, data, offs in K.chunks(batches, 1):
            known = part.column(0).is_valid().to_pylist()
            for u, ok in zip(shingle_sets(data, offs, k), known, strict=True):
                if not ok or not len(u):
                    continue
                c = set_hash(u)
                if c in seen:
                    continue
                seen.add(c)
                front = prefix(u, ORDERS[0], often, shift, percent)
                ids.append(token_id(front, shift))
                owners.append((c, len(front)))
                total += len(front)
            if total > FLUSH:
                yield from flush()
                total = 0
                seen.clear()
        yield from flush()

    def meet(batches):
        def close(bucket, blobs):
            tok = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 12) for x in blobs])
            cls = np.concatenate([np.frombuffer(x, np.int64, len(x) // 12, len(x) // 12 * 4) for x in blobs])
            order = np.lexsort((cls, tok))
            tok, cls = tok[order], cls[order]
            one = np.r_[True, (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])]
            tok, cls = tok[one], cls[one]
            cut = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
            size = np.diff(np.r_[cut, len(tok)])
            with np.errstate(over="ignore"):
                name = K.mix(np.add.reduceat(K.mix(K.unsigned(cls)), cut) ^ (size.astype(K.U) << K.U(32)) ^ K.U(bucket))
            more = np.flatnonzero(size > 1)
            _, lead, weight = np.unique(name[more], return_index=True, return_counts=True)
            first = more[lead]
            for lo in range(0, len(first), 20_000):
                f, wt = first[lo : lo + 20_000], weight[lo : lo + 20_000]
                n = size[f]
                at = np.repeat(cut[f] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                for a in range(0, len(at), 200_000):
                    sl = slice(a, a + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(np.repeat(name[f], n)[sl])), pa.array(cls[at[sl]]), pa.array(np.repeat(n, n)[sl].astype(np.int64)), pa.array(np.repeat(wt, n)[sl].astype(np.int64))], names)
            lots = more[size[more] > LONG_LIST]
            if len(lots):
                ids = (K.U(bucket) << K.U(32)) | tok[cut[lots]].astype(K.U)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(ids)), pa.nulls(len(lots), pa.int64()), pa.array(size[lots].astype(np.int64)), pa.nulls(len(lots), pa.int64())], names)

        names = ["list", "cls", "size", "weight"]
        at, blobs = None, []
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != at and blobs:
                    yield from close(at, blobs)
                    blobs = []
                at = b
                blobs.append(x)
        if blobs:
            yield from close(at, blobs)

    sent = docs.mapInArrow(send, "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    return table(sent.mapInArrow(meet, "list long, cls long, size long, weight long"), "postings")


def fronts(u: np.ndarray, common: np.ndarray, shift: int, percent: int = PERCENT) -> bytes:
    """The prefixes of a set under the further orders, 32 bits a token, each sorted."""
    return b"".join(np.sort((K.mix(prefix(u, seed, common, shift, percent) ^ K.U(seed)) >> K.U(32)).astype(np.uint32)).tobytes() for seed in ORDERS[1:])


def passes(na: int, nb: int, fa: np.ndarray, fb: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets of sizes ``na`` and ``nb`` with the ``fronts`` of each order share as many prefix tokens under each further order as similar sets must.

    Equal numbers of different tokens can only let more pairs through, as repeats in a prefix count each.
    """
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    least = -(-percent * (na + nb) // (100 + percent))
    for x, y in zip(fa, fb, strict=True):
        bound = max(1, min(len(x) - (na - least), len(y) - (nb - least)))
        if int(np.count_nonzero(_found(x, y))) < bound:
            return False
    return True


def alike(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on two sorted sets."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = int(np.count_nonzero(_found(x, y)))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _found(sorted_: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``other`` are in a sorted list that is not empty."""
    j = np.searchsorted(sorted_, other)
    j[j == len(sorted_)] = 0
    return sorted_[j] == other


def _segment(key: str):
    return F.pmod(F.xxhash64(key), F.lit(SEGMENTS)).cast("int")


def id_filter(ids: DataFrame) -> dict[int, bytes]:
    """A Bloom filter of the longs in ``doc_id``, sixteen bits each up to MOST_BITS in all, in segments that executors build.

    A fuller filter lets more rows through and loses none.
    """
    count = ids.count()
    bits = min(MOST_BITS, max(16, (16 * count).bit_length())) - (SEGMENTS.bit_length() - 1)

    def build(batches):
        segs: dict[int, K.Bloom] = {}
        for batch in batches:
            of, keys = batch.column(0).to_numpy(), K.mix(K.unsigned(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))
            for s in np.unique(of):
                segs.setdefault(int(s), K.Bloom(bits)).add(K.mix(keys[of == s]))
        if segs:
            yield pa.RecordBatch.from_arrays([pa.array(list(segs), pa.int32()), pa.array([zlib.compress(b.data.tobytes(), 1) for b in segs.values()], pa.binary())], ["s", "bits"])

    rows = ids.select(_segment("doc_id").alias("s"), "doc_id").repartition(SEGMENTS, "s").mapInArrow(build, "s int, bits binary").collect()
    return {r["s"]: bytes(r["bits"]) for r in rows}


def sifted(rows: DataFrame, wanted: DataFrame, then=None, schema: str | None = None) -> DataFrame:
    """The rows whose ``doc_id`` is among the wanted ones, and some others; nothing is shuffled. ``then`` goes on with their batches."""
    held = rows.sparkSession.sparkContext.broadcast(id_filter(wanted))
    names = rows.columns

    def sift(batches):
        segs = {}
        for s, b in held.value.items():
            data = np.frombuffer(zlib.decompress(b), np.uint8)
            segs[s] = K.Bloom(len(data).bit_length() + 2, data)
        for batch in batches:
            of, keys = batch.column(len(names)).to_numpy(), K.mix(K.unsigned(batch.column(names.index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)))
            found = np.zeros(len(keys), bool)
            for s, b in segs.items():
                at = np.flatnonzero(of == s)
                found[at] = b.has(K.mix(keys[at]))
            if found.any():
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(found))

    def run(batches):
        yield from then(sift(batches)) if then else sift(batches)

    return rows.where("doc_id IS NOT NULL").select(*names, _segment("doc_id").alias("s")).mapInArrow(run, schema or rows.schema)


def cells(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(i, j, salt, a, b)``: the pairs by the places where they are compared.

    Each class joins its neighbour of most pairs, or itself; such a group is cut by hash into blocks of about CELL tokens.
    A pair belongs to the two blocks of its classes, so a class travels once to each two blocks that have a pair of
    it, however many pairs. Groups of many pairs are salted by ``b``, PAIRS or so to a place.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # each step is written, as the next ones read it several times: in one plan the steps before would be planned and run again for every use
    degree = table(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d")).join(sizes.withColumnRenamed("cls", "node"), "node"), "degree")
    near = both.join(degree.select(F.col("node").alias("b"), "d"), "b").groupBy(F.col("a").alias("node")).agg(F.max(F.struct("d", "b")).alias("top"))
    own = F.struct(F.col("d"), F.col("node").alias("b"))
    found = table(degree.join(near, "node").select("node", "d", "n", F.greatest(own, "top")["b"].alias("root")), "roots")
    wide = found.groupBy("root").agg(F.ceil(F.sum("n") / CELL).alias("blocks"), F.ceil(F.sum("d") / PAIRS).alias("salts"))
    at = table(found.join(wide, "root").select("node", F.xxhash64("root", F.pmod(F.xxhash64("node"), "blocks")).alias("unit"), "salts"), "units")
    one, two = (at.select(F.col("node").alias(c), F.col("unit").alias(f"u{c}"), F.col("salts").alias(f"s{c}")) for c in ("a", "b"))
    salt = F.pmod(F.xxhash64("b"), F.greatest("sa", "sb"))
    made = table(pairs.join(one, "a").join(two, "b").select(F.least("ua", "ub").alias("i"), F.greatest("ua", "ub").alias("j"), salt.alias("salt"), "a", "b"), "cells")
    discard(degree, found, at)
    return made


def members(placed: DataFrame, reps: DataFrame) -> DataFrame:
    """``(cls, doc_id)`` of the classes of some pairs."""
    return placed.select(F.col("a").alias("cls")).unionByName(placed.select(F.col("b").alias("cls"))).distinct().join(reps.select("cls", "doc_id"), "cls")


def compared(placed: DataFrame, payload: DataFrame, form, check) -> DataFrame:
    """The rows of ``cells`` that pass ``check(x, y)``, x and y made by ``form`` from a column of ``payload(cls, n, payload)``."""
    cell = ["i", "j", "salt"]
    sent = placed.select(*cell, F.explode(F.array("a", "b")).alias("cls")).distinct().join(payload, "cls")
    sent = sent.select(*cell, F.lit(0).alias("kind"), F.col("cls").alias("a"), F.col("n").alias("b"), "payload")
    asks = placed.select(*cell, F.lit(1).alias("kind"), "a", "b", F.lit(None).cast(payload.schema["payload"].dataType).alias("payload"))
    rows = sent.unionByName(asks).repartition(*cell).sortWithinPartitions(*cell, "kind")

    def run(batches):
        at, held = None, {}
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            kind = batch.column(3).to_numpy()
            edges = [0, *(x for x in range(1, len(where)) if where[x] != where[x - 1] or kind[x] != kind[x - 1]), len(where)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if where[lo] != at:
                    at, held = where[lo], {}
                part = batch.slice(lo, hi - lo)
                a, b = part.column(4).to_pylist(), part.column(5).to_pylist()
                if kind[lo] == 0:
                    held.update(zip(a, form(b, part.column(6)), strict=True))
                else:
                    ok = [check(held[x], held[y]) for x, y in zip(a, b, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), part.column(4), part.column(5)], [*cell, "a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, "i long, j long, salt long, a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, common: np.ndarray, shift: int, k: int, percent: int) -> DataFrame:
    """The candidate pairs ``(a, b)`` of classes that are similar; ``reps(cls, doc_id, n)`` has a document of each class.

    First the packed prefixes under all further orders meet. Only the texts of pairs that pass are brought together.
    """
    held = docs.sparkSession.sparkContext.broadcast(common)
    pairs = table(pairs, "pairs")

    def form(batches):
        for part, data, offs in K.chunks(batches, 1):
            out = ([], [], [])
            for u in shingle_sets(data, offs, k):
                for c, v in zip(out, (set_hash(u), len(u), fronts(u, held.value, shift, percent)) if len(u) else (None, 0, b""), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)), part.column(1)], ["doc_id", "cls", "n", "fronts", "text"])

    placed = cells(pairs, reps.select("cls", "n"))
    wanted = table(members(placed, reps), "wanted")
    forms = table(sifted(docs.select("doc_id", "text"), wanted, form, "doc_id long, cls long, n long, fronts binary, text string"), "forms")
    signs = forms.join(wanted, ["doc_id", "cls"]).groupBy("cls").agg(F.first("n").alias("n"), F.first("fronts").alias("payload"))
    left = compared(
        placed, signs, lambda n, column: [(size, np.frombuffer(x, np.uint32).reshape(len(ORDERS) - 1, -1)) for size, x in zip(n, column.to_pylist(), strict=True)],
        lambda x, y: passes(x[0], y[0], x[1], y[1], percent),
    )
    left = table(left, "passed")
    needs = members(left, reps)
    texts = forms.select("doc_id", "cls", "n", "text").join(needs, ["doc_id", "cls"]).groupBy("cls").agg(F.first("n").alias("n"), F.first("text").alias("payload"))

    def sets(_n, column):
        return [u for part, data, offs in K.chunks(iter([pa.RecordBatch.from_arrays([column], ["t"])]), 0) for u in shingle_sets(data, offs, k)]

    links = table(compared(left, texts, sets, lambda x, y: alike(x, y, percent)).select("a", "b"), "links")
    discard(pairs, placed, wanted, forms, left)
    return links


def _enough(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b, na, nb, shared)`` whose sizes and shared prefix tokens allow the similarity."""
    na, nb = F.col("na"), F.col("nb")
    least = F.ceil((percent * (na + nb)) / F.lit(100 + percent))
    pa_, pb_ = na - F.ceil(percent * na / 100) + 1, nb - F.ceil(percent * nb / 100) + 1
    bound = F.least(pa_ - (na - least), pb_ - (nb - least))
    sizes = (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    return pairs.where(sizes & (F.col("shared") >= bound))


def _labelled(lists: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return lists.select("list", "cls", "n", "weight", F.col("cls").alias("label"))
    return lists.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("list", "cls", "n", "weight", F.coalesce("root", "cls").alias("label"))


def _long_pairs(at: DataFrame, lists: DataFrame, percent: int, spent: list[DataFrame]) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of classes that are apart, of one group of long ``lists``, and share enough prefix tokens.

    Long lists of a group have much the same classes, so pairs are not counted list by list. Classes that long lists connect
    are cut into blocks of BLOCK, each class goes with its packed lists to every two blocks that hold its own, and a matrix product counts there.
    """
    held = at.join(lists.select("list"), "list", "left_semi")
    heads = held.groupBy("list").agg(F.min("cls").alias("a"))
    groups = components(held.join(heads, "list").select("a", F.col("cls").alias("b")).distinct()).select(F.col("node").alias("cls"), F.col("root").alias("g"))
    wide = groups.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = groups.join(wide, "g").select("cls", "g", "blocks", F.pmod(F.xxhash64("cls"), "blocks").alias("mine"))
    packed = at.join(groups.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_list(F.struct("list", "weight")).alias("lists"))
    sent = placed.join(packed, "cls").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = [F.col("g"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")]
    rows = sent.select(*cell, "mine", "cls", "n", "label", "lists").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")

    def close(where, held):
        mine, cls, n, label = (np.array([r[k] for r in held], np.int64) for k in range(4))
        size = np.array([len(r[4][0]) for r in held])
        lists, weight = (np.concatenate([r[4][k] for r in held]) for k in (0, 1))
        names, column = np.unique(lists, return_inverse=True)
        row, total = np.repeat(np.arange(len(held)), size), np.zeros((len(held), len(held)))
        for lo in range(0, len(names), 4096):  # a stretch of lists at a time
            some = (column >= lo) & (column < lo + 4096)
            has = np.zeros((len(held), min(4096, len(names) - lo)), np.float32)
            has[row[some], column[some] - lo] = 1
            weighed = has.copy()
            weighed[row[some], column[some] - lo] = weight[some]
            total += has @ weighed.T
        na, nb = n[:, None], n[None]
        least = -(-percent * (na + nb) // (100 + percent))
        first = n - (-(-percent * n // 100)) + 1
        bound = np.minimum(first[:, None] - (na - least), first[None] - (nb - least))
        ok = (total >= np.maximum(bound, 1)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (label[:, None] != label[None]) & (cls[:, None] < cls[None])
        if where[1] != where[2]:
            ok &= mine[:, None] != mine[None]
        a, b = np.nonzero(ok)
        for lo in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(cls[a[lo : lo + 50_000]]), pa.array(cls[b[lo : lo + 50_000]])], ["a", "b"])

    def run(batches):
        at_, held = None, []
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in range(7)]
            packs = batch.column(7)
            offs, flat = packs.offsets.to_numpy(), packs.values
            fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            for r, (g, i, j, mine, cls, n, label) in enumerate(zip(*keys, strict=True)):
                if (g, i, j) != at_ and held:
                    yield from close(at_, held)
                    held = []
                at_ = (g, i, j)
                held.append((mine, cls, n, label, tuple(f[offs[r] : offs[r + 1]].copy() for f in fields)))
        if held:
            yield from close(at_, held)

    made = table(rows.mapInArrow(run, "a long, b long"), "long_pairs")
    spent.append(made)
    return made


def _askers(at: DataFrame, found: DataFrame | None, apart: DataFrame, percent: int, spent: list[DataFrame]) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of classes that are apart and share enough prefix tokens over all lists.

    Components are ordered by size, the same in every list: the class of the smaller one asks, so a pair is counted on one side. Each
    asker gets the classes of a list in packed pieces, so a list costs rows in proportion to those who
    ask. All of an asker's pieces meet and are counted there.
    """
    mixed = at.join(apart.select("list"), "list", "left_semi")
    if found is None:
        mixed = mixed.withColumn("mass", F.lit(1).cast("long"))
    else:
        mass = found.groupBy(F.col("root").alias("label")).agg(F.count("*").alias("mass"))
        mixed = mixed.join(mass, "label", "left").withColumn("mass", F.coalesce("mass", F.lit(1)).cast("long"))
    mixed = table(mixed.select("list", "cls", "n", "weight", "label", "mass"), "mixed")
    top = mixed.groupBy("list").agg(F.max(F.struct("mass", "label")).alias("top"), F.count("*").alias("size"))
    top = table(top, "top")
    spent += [mixed, top]
    mixed = mixed.join(top, "list")
    piece = F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / PIECE))
    packed = mixed.groupBy("list", piece.alias("piece")).agg(F.collect_list(F.struct("cls", "n", "label", "mass")).alias("m"))
    rows = mixed.where("label <> top.label").select("list", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), "weight", F.col("mass").alias("ma"))
    # an asker gets those of larger components only, of a size that allows the similarity
    fit = f"transform(filter(m, x -> (x.mass > ma OR (x.mass = ma AND x.label > la)) AND 100 * x.n >= {percent} * na AND 100 * na >= {percent} * x.n), x -> named_struct('cls', x.cls, 'n', x.n))"
    rows = rows.join(packed.select("list", "m"), "list").select("a", "na", "weight", F.expr(fit).alias("m")).where("size(m) > 0").repartition("a").sortWithinPartitions("a")

    def count(batches):
        a, na, held = None, 0, []

        def close():
            cls, n, w = (np.concatenate(c) for c in zip(*held, strict=True))
            got, first, at_ = np.unique(cls, return_index=True, return_inverse=True)
            shared, nb = np.bincount(at_, w, len(got)), n[first]
            least = -(-percent * (na + nb) // (100 + percent))
            fa, fb = na - needed(na, percent) + 1, nb - (-(-percent * nb // 100)) + 1
            got = got[shared >= np.minimum(fa - (na - least), fb - (nb - least))]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(got, a)), pa.array(np.maximum(got, a))], ["a", "b"])

        for batch in batches:
            who, size, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lists = batch.column(3)
            offs, flat = lists.offsets.to_numpy(), lists.values
            fields = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)]
            edges = np.flatnonzero(np.r_[True, who[1:] != who[:-1], True]) if len(who) else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and int(who[lo]) != a:
                    yield close()
                    held = []
                a, na = int(who[lo]), int(size[lo])
                s = slice(offs[lo], offs[hi])
                held.append((*(x[s] for x in fields), np.repeat(weight[lo:hi], np.diff(offs[lo : hi + 1]))))
        if held:
            yield close()

    return rows.mapInArrow(count, "a long, b long").distinct()


def _joined(src: DataFrame, k: int, percent: int) -> DataFrame:
    """``(doc_id, n, cls, mark, component_id)`` for every row of ``src(doc_id, text)``."""
    spark = src.sparkSession
    buckets = 1 << min(20, max(6, (partitions(spark) - 1).bit_length()))
    shift = 64 - (buckets.bit_length() - 1) - 32
    rows, common = classes(src, shift, k)
    reps = table(rows.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "reps")
    size, count = reps.select("cls", "n"), rows.count()
    none = spark.createDataFrame([], "a long, b long")
    links, tried = none, none
    found = None  # components of the links so far
    spent: list[DataFrame] = []
    for last in (*[False] * (ROUNDS - 1), True):
        made = postings(src, common, buckets, k, percent)
        lists = made.where("weight IS NOT NULL")
        # the class with most partners in all its lists heads each of them
        heads = lists.groupBy("cls").agg(F.sum(F.col("weight") * F.col("size")).alias("pop")).join(size, "cls")
        lists = table(lists.join(heads, "cls"), "lists")
        long = table(made.where("weight IS NULL").select("list", "size"), "long")
        discard(made)
        tops = table(lists.groupBy("list").agg(F.max_by(F.struct("cls", "n"), F.struct("pop", "cls")).alias("t")), "tops")
        for turn in range(STARS + 1):
            # what is apart within a list: few enough pairs are all compared, else a star joins some first
            at = _labelled(lists, found)
            parts = at.groupBy("list", "label").agg(F.count("*").alias("c"))
            apart = parts.groupBy("list").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")).where("pairs > 0")
            apart = table(apart, "apart")
            spent.append(apart)
            much = apart.agg(F.sum("pairs")).first()[0] or 0
            many = much > MOST_PAIRS * count
            if turn == STARS or not many and found is not None:
                break
            star = at.join(tops, "list").withColumn("a", F.col("t.cls"))
            if found is None:
                star = star.where("cls <> a")
            else:
                star = star.join(found.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").where("label <> coalesce(ra, a)")
            star = star.groupBy("a", F.col("cls").alias("b")).agg(F.first("t.n").alias("na"), F.first("n").alias("nb"), F.sum("weight").alias("shared"))
            # each class asks the one head it shares most with, of those not asked yet
            star = _enough(star, percent).join(tried, ["a", "b"], "left_anti").groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
            star = table(star, "star")
            spent.append(star)
            asked = star.count()
            if not asked or found is not None and asked * FEW < much:
                break
            good = verified(src, star, reps, common, shift, k, percent)
            tried, links = tried.unionByName(star), links.unionByName(good)
            spent.append(good)
            if good.isEmpty():
                break
            found = components(links)
        if last or not many:
            break
        lots = long.orderBy(F.desc("size"), "list").limit(MOST_COMMON).select("list").collect()
        late = np.union1d(common, K.unsigned(np.array([r[0] for r in lots], np.int64)))
        if len(late) == len(common):
            break
        common = late
        discard(lists, tops, long)
    spent += [lists, tops, long]
    # lists that are still long are counted in blocks, the others list by list
    sized = lists.join(apart.select("list"), "list", "left_semi").select("list", "size").distinct()
    lots = table(sized.where(F.col("size") > LONG_LIST), "lots")
    spent.append(lots)
    near = _askers(at, found, apart.join(lots, "list", "left_anti"), percent, spent)
    if not lots.isEmpty():
        near = near.unionByName(_long_pairs(at, lots, percent, spent)).distinct()
    both = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = verified(src, near.join(both, ["a", "b"], "left_anti"), reps, common, shift, k, percent)
    spent.append(more)
    if not more.isEmpty():
        found = components(links.unionByName(more))

    if found is None:
        discard(*spent)
        named = reps.select("cls", F.col("doc_id").alias("head"))
        return rows.join(named, "cls", "left").select("doc_id", "n", "cls", "mark", F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id")).alias("component_id"))
    labels = reps.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.col("doc_id").alias("least"), F.coalesce("root", "cls").alias("label"))
    heads = labels.groupBy("label").agg(F.min("least").alias("head"))
    named = table(labels.join(heads, "label").select("cls", "head"), "named")
    discard(*spent, reps)
    out = rows.join(named, "cls", "left")
    return out.select("doc_id", "n", "cls", "mark", F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id")).alias("component_id"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``, named as said whatever ``key`` is called.

    Words are lower-cased in A-Z. ``component_id`` is the smallest key reachable by links of similarity
    ``percent`` or more. Null, empty and wordless texts have no shingles, no links and their own key. Rows with a
    null key are linked with nothing and get a null component. Repeated rows get the same answer each; rows that share a
    key and not the text are told apart. Keys are whole numbers; other columns are not read; an empty table gives no row.
    """
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _joined(src, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, without those that have a similar document of smaller key.

    Of each group the row of the smallest key stays, and of several such rows with equal sets the one whose text
    has the least hash. Rows with a null key or without words stay, and so do rows that share a key but not a set.
    """
    names = docs.columns
    own = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), docs[key].cast("long").alias("id"), docs[text].alias("text"))
    own = own.select("row", "id", F.xxhash64("text").alias("mark"))
    src = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    found = _joined(src, k, percent).where("n > 0 AND doc_id IS NOT NULL")
    same = table(found.groupBy("doc_id", "cls").agg(F.min("component_id").alias("c"), F.count("*").alias("rows"), F.min("mark").alias("first"), F.collect_set("mark").alias("marks")), "same")
    gone = same.where("doc_id <> c").select(F.col("doc_id").alias("id"), F.explode("marks").alias("mark"))
    again = same.where("doc_id = c AND rows > 1")
    late = again.select(F.col("doc_id").alias("id"), F.explode("marks").alias("mark"), "first").where("mark <> first").drop("first")
    once = again.select(F.col("doc_id").alias("id"), F.col("first").alias("mark"))
    stay = own.join(gone.unionByName(late).unionByName(once).distinct(), ["id", "mark"], "left_anti").select("row.*")
    single = own.join(once, ["id", "mark"]).groupBy("id", "mark").agg(F.first("row").alias("row")).select("row.*")
    return stay.toDF(*names).unionByName(single.toDF(*names)) if len({c.lower() for c in names}) == len(names) else stay.union(single)
