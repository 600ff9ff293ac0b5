"""Embedding near-duplicates by product quantisation over inverted lists.

Unit vectors go to the inverted list of their nearest coarse centroid and keep a code of the residual, one small
codebook per subspace. A query visits every list that could hold a partner: a partner within the bound lies
no farther beyond the bisecting plane of two centroids than the bound, so skipping the other lists loses
nothing. In a list, distances to the coded vectors come from table look-ups; a coded vector whose look-up
distance exceeds the bound by more than its own, stored, coding error cannot be a partner. What is left is decided by the exact cosine in
double precision, so recall does not depend on the sample the codebooks were fitted on.

Equal vectors of a label are one class. Long lists are cut into blocks that meet block by block. A block
pair sends link counts per vector and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import components, table

COSINE = 0.93
#: Rows the codebooks are fitted on at most; subspaces; codewords of each; rows of a block.
SAMPLE, SUBSPACES, WORDS, BLOCK = 20_000, 16, 16, 4096


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)
    at = d.argmin(1)
    return at, d


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; an empty cell keeps its centre."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at, _ = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def fit(x: np.ndarray, lists: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Coarse centroids of unit vectors, and a codebook of the residuals for each subspace."""
    coarse = k_means(x, lists)
    rest = x - coarse[_nearest(x, coarse)[0]]
    cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    return coarse, [k_means(rest[:, a:b], WORDS, 5) for a, b in zip(cuts, cuts[1:], strict=False)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _assign(model, bound: float):
    """Rows of classes to (dim, label, list, role, cls, n, vec, code, err): stored (0), and as a query of the own list (1) and of each later list to visit (2)."""

    def run(batches):
        fitted = model.value
        for batch in batches:
            ids, labels, n, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            size = np.array([len(v) for v in vectors], np.int64)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = np.array(vectors.take(pa.array(at)).to_pylist(), np.float64)
                x = x / np.linalg.norm(x, axis=1)[:, None]
                coarse, books = fitted[int(dim)]
                home, d = _nearest(x, coarse)
                own = d[np.arange(len(x)), home]
                gap = np.sqrt(_nearest(coarse, coarse)[1])[home]
                visit = (d - own[:, None] <= 2 * bound * gap + 1e-9) & (np.arange(len(coarse))[None] >= home[:, None])
                visit[np.arange(len(x)), home] = True
                rest, code, guess = x - coarse[home], np.zeros((len(x), len(books)), np.uint8), np.zeros_like(x)
                lo = 0
                for j, book in enumerate(books):
                    hi = lo + book.shape[1]
                    code[:, j] = _nearest(rest[:, lo:hi], book)[0]
                    guess[:, lo:hi] = book[code[:, j]]
                    lo = hi
                err = np.linalg.norm(rest - guess, axis=1)
                q, c = np.nonzero(visit)
                row, where = np.r_[np.arange(len(x)), q], np.r_[home, c]
                role = np.r_[np.zeros(len(x), np.int8), np.where(c == home[q], 1, 2).astype(np.int8)]
                raw, codes = [v.tobytes() for v in x], [v.tobytes() for v in code]
                for lo in range(0, len(row), 20_000):
                    s = slice(lo, lo + 20_000)
                    r = row[s]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(r), dim), pa.int32()), pa.array(labels[at[r]], pa.int64()), pa.array(where[s], pa.int32()), pa.array(role[s], pa.int32()), pa.array(ids[at[r]], pa.int64()),
                            pa.array(n[at[r]], pa.int64()), pa.array([raw[i] for i in r], pa.binary()), pa.array([codes[i] for i in r], pa.binary()), pa.array(err[r], pa.float64()),
                        ],
                        ["dim", "label", "list", "role", "cls", "n", "vec", "code", "err"],
                    )

    return run


def _forest(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links join: all of them if few, else a star for each group."""
    q, s = np.nonzero(links)
    if len(q) <= 4 * (len(a) + len(b)):
        return list(zip(a[q].tolist(), b[s].tolist(), strict=True))
    out, todo = [], links.any(1)
    while todo.any():
        root = int(np.argmax(todo))
        mine, reach = np.zeros(len(a), bool), np.zeros(len(b), bool)
        mine[root] = True
        while True:
            grown = links[mine].any(0)
            again = links[:, grown].any(1)
            if (again == mine).all() and (grown == reach).all():
                break
            mine, reach = again | mine, grown
        out += [(int(a[root]), int(x)) for x in b[reach]] + [(int(a[root]), int(x)) for x in a[mine]]
        todo &= ~mine
    return out


def _meet(model, cosine: float):
    """A block pair: look-up distances, exact cosines of what they leave, then counts and forest."""
    bound = float(np.sqrt(2 - 2 * cosine))

    def block(dim, lst, role, cls, n, vec, code, err):
        coarse, books = model.value[dim]
        st, qu = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
        if not len(st) or not len(qu):
            return [], [], []
        x = np.frombuffer(b"".join(vec), np.float64).reshape(-1, dim)
        codes = np.frombuffer(b"".join(code), np.uint8).reshape(len(vec), -1)[st]
        counts, forest = np.zeros(len(vec), np.int64), []
        y, rest = x[st], x[qu] - coarse[lst]
        most = (bound + err[st] + 1e-9) ** 2
        links = np.zeros((len(qu), len(st)), bool)
        for lo in range(0, len(qu), 1024):
            s = slice(lo, lo + 1024)
            far, at = np.zeros((len(qu[s]), len(st))), 0
            for j, book in enumerate(books):
                to = at + book.shape[1]
                far += _nearest(rest[s, at:to], book)[1][:, codes[:, j]]
                at = to
            # within a list each pair is met from both sides: the smaller class asks
            near = (far <= most[None]) & ((cls[qu[s]][:, None] < cls[st][None]) | (role[qu[s]] == 2)[:, None])
            i, k = np.nonzero(near)
            if len(i) > near.size // 20:
                links[s] = near & (x[qu[s]] @ y.T >= cosine)
            elif len(i):
                ok = np.concatenate([np.einsum("ij,ij->i", x[qu[s]][i[u : u + 100_000]], y[k[u : u + 100_000]]) for u in range(0, len(i), 100_000)]) >= cosine
                links[lo + i[ok], k[ok]] = True
        counts[qu] = links @ n[st]
        counts[st] += n[qu] @ links
        forest = _forest(links, cls[qu], cls[st])
        hit = np.flatnonzero(counts)
        return cls[hit].tolist() + [a for a, _ in forest], [None] * len(hit) + [b for _, b in forest], counts[hit].tolist() + [0] * len(forest)

    def run(batches):
        held, at = None, None
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for r in zip(*cols, strict=True):
                if r[:5] != at:
                    if held:
                        yield from close(at, held)
                    at, held = r[:5], []
                held.append(r[5:])
        if held:
            yield from close(at, held)

    def close(at, rows):
        role, cls, n, vec, code, err = zip(*rows, strict=True)
        a, b, c = block(at[0], at[2], np.array(role), np.array(cls, np.int64), np.array(n, np.int64), vec, code, np.array(err))
        for lo in range(0, len(a), 50_000):
            s = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(v[s], pa.int64()) for v in (a, b, c)], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row, named as said whatever ``key`` is called.

    Only rows of one label are compared, and not those whose label is null. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing; vectors of different lengths neither. Repeated vectors link
    with each other; rows that share a key count as rows. A row with a null key is compared with nothing and gets null.
    An empty table gives no row. Other columns are not read.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("label"))
    finite = F.expr("size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")
    usable = F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # scaled by the greatest component, so that neither tiny nor huge ones leave the range of doubles
    scaled = F.expr("transform(v, x -> x / array_max(transform(v, y -> abs(y))))")
    rows = src.withColumn("ok", usable)
    same = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n"))
    same = table(same, "vectors")
    total = same.count()
    if not total:
        return src.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    lists = int(min(1024, max(8, total**0.5 / 8)))
    fitted = {}
    for r in same.select(F.size("v").alias("d")).distinct().collect():
        sample = same.where(F.size("v") == r["d"]).orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select(scaled.alias("v")).collect()  # SAMPLE rows at most
        x = np.array([s["v"] for s in sample], np.float64)
        fitted[r["d"]] = fit(x / np.linalg.norm(x, axis=1)[:, None], lists)
    model = spark.sparkContext.broadcast(fitted)
    bound = float(np.sqrt(2 - 2 * cosine))
    placed = table(same.select("cls", "label", "n", scaled.alias("v")).mapInArrow(_assign(model, bound), "dim int, label long, list int, role int, cls long, n long, vec binary, code binary, err double"), "placed")

    cell = ["dim", "label", "list"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count_if(F.col("role") == 0) / BLOCK).cast("int").alias("ns"), F.ceil(F.count_if(F.col("role") > 0) / BLOCK).cast("int").alias("nq"))
    at = placed.join(sizes.where("ns > 0 AND nq > 0"), cell)
    # stored block i meets query block j: a row knows its own and is sent to all of the other side
    mine = F.when(F.col("role") == 0, F.pmod(F.xxhash64("cls"), "ns")).otherwise(F.pmod(F.xxhash64("cls"), "nq")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("nq")).otherwise(F.col("ns")) - 1))
    at = at.withColumn("mine", mine).withColumn("other", other)
    pair = F.when(F.col("role") == 0, F.struct(F.col("mine").alias("s"), F.col("other").alias("q"))).otherwise(F.struct(F.col("other").alias("s"), F.col("mine").alias("q")))
    at = at.select(*cell, pair.alias("p"), "role", "cls", "n", "vec", "code", "err").select(*cell, "p.s", "p.q", "role", "cls", "n", "vec", "code", "err")
    met = at.repartition(*cell, "s", "q").sortWithinPartitions(*cell, "s", "q").mapInArrow(_meet(model, cosine), "a long, b long, n long")
    met = table(met, "met")
    counts = met.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("more"))
    found = components(met.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cls")
    known = same.join(counts, "cls", "left").join(found, "cls", "left").select("label", "v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("root", "cls").alias("root"))
    out = rows.withColumn("kl", F.when(F.col("ok"), F.col("label"))).withColumn("kv", F.when(F.col("ok"), F.col("v")))
    out = out.join(known.withColumnRenamed("label", "kl").withColumnRenamed("v", "kv"), ["kl", "kv"], "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), (F.coalesce("root", "vec_id") == F.col("vec_id")).alias("kept"))
