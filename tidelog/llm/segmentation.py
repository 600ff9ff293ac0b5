"""SentencePiece encoding and decoding with distinct sampled segmentations.

Segmentations of a text are the paths of a lattice of vocabulary pieces; a path's weight is the sum of its pieces'
log-probabilities. ``k`` distinct paths are drawn without replacement by the Gumbel-top-k trick as an A-star search: a node is
a set of paths (a prefix and the choices already taken out of its next step), its key is the greatest perturbed
weight in the set, drawn from a Gumbel truncated at the key of the set it was split from. The best node is opened by sampling one path through
it; what is left at each step of that path becomes a node. Keys are exact maxima, so paths come out in the order of their perturbed
weights, and only the best ``k`` nodes need be kept. Pieces never cross from a word into the next one, so lattices are per
word and are reused.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import zlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import spread

SAMPLES, THETA = 4, 1.0
#: Words whose lattices a worker keeps, about 5 KB each.
CACHE = 32_000
_UNIT = re.compile("▁+[^▁]*|[^▁]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattices:
    """The pieces of a model with log-probabilities, and conditional tables of words.

    A model whose scores are whole numbers ranks its merges; its pieces get Zipf weights by that rank. Other
    scores are log-probabilities already. Characters outside the vocabulary are one step of byte pieces, or the unknown piece.
    """

    def __init__(self, path: str, theta: float):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = {i: sp.get_score(i) for i in plain}
        if all(v == int(v) for v in score.values()):
            rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-score[i], i)))}
            score = {i: -math.log(rank[i] + 2.0) for i in plain}
        norm = math.log(sum(math.exp(v) for v in score.values()))
        made = {sp.id_to_piece(i): ((i,), theta * (v - norm), math.exp(theta * (v - norm))) for i, v in score.items()}
        least = min(w for _, w, _ in made.values())
        # what only begins a piece is there too, as None: a string that isn't there has no longer piece behind it
        self.pieces = {p[:n]: None for p in made for n in range(1, len(p))} | made
        self.bytes = {b: i for i in range(len(sp)) if sp.is_byte(i) for b in [int(sp.id_to_piece(i)[3:5], 16)]}
        self.unknown, self.least = sp.unk_id(), least
        self.cache: dict[str, tuple] = {}

    def _steps(self, unit: str, a: int) -> list:
        """The steps from a place of a word: (next place, (ids, log-weight, weight))."""
        mine, n, pieces = [], len(unit), self.pieces
        for b in range(a + 1, n + 1):
            p = pieces.get(unit[a:b], False)
            if p is False:
                break
            if p:
                mine.append((b, p))
        if not mine or mine[0][0] != a + 1:  # a character without a piece
            raw = unit[a].encode("utf-8", "surrogatepass")
            ids = tuple(self.bytes[x] for x in raw) if len(self.bytes) == 256 else (self.unknown,)
            mine.append((a + 1, (ids, self.least * len(ids), math.exp(self.least * len(ids)))))
        return mine

    def _chances(self, steps: list) -> list:
        """Probabilities of the steps of each place: weights of what follows are multiplied, or their logs added where products grow too small."""
        n = len(steps)
        after, chances = [1.0] * (n + 1), [None] * n
        for a in range(n - 1, -1, -1):
            w = [p[2] * after[b] for b, p in steps[a]]
            after[a] = total = sum(w)
            if total < 1e-280:
                break
            chances[a] = [x / total for x in w]
        else:
            return chances
        after = [0.0] * (n + 1)
        for a in range(n - 1, -1, -1):
            w = [p[1] + after[b] for b, p in steps[a]]
            top = max(w)
            e = [math.exp(x - top) for x in w]
            total = sum(e)
            after[a] = top + math.log(total)
            chances[a] = [x / total for x in e]
        return chances

    def word(self, unit: str) -> tuple:
        """For each place of a word: cumulative probabilities, next places, ids and probabilities of its steps."""
        found = self.cache.get(unit)
        if found is not None:
            return found
        steps = [self._steps(unit, a) for a in range(len(unit))]
        # tuples of numbers, which the garbage collector doesn't walk
        table = tuple((tuple(accumulate(e)), tuple([b for b, _ in s]), tuple([p[0] for _, p in s]), tuple(e)) for s, e in zip(steps, self._chances(steps), strict=True))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[unit] = table
        return table


@functools.lru_cache(maxsize=2)
def lattices(path: str, theta: float) -> Lattices:
    return Lattices(path, theta)


class _Path:
    """A sampled path: for each step its word, place, choice and conditional probability."""

    __slots__ = ("ids", "probs", "steps", "taken")

    def __init__(self):
        self.steps, self.probs, self.ids, self.taken = [], [], [], {}


def _descend(tables: list, path: _Path, word: int, place: int, draws) -> None:
    """Follows a path to the end of the text, each step drawn by its probability."""
    steps, probs, ids = path.steps, path.probs, path.ids
    for w in range(word, len(tables)):
        table = tables[w]
        a, n = (place if w == word else 0), len(table)
        while a < n:
            cum, nxt, pieces, p = table[a]
            last = len(cum) - 1
            c = bisect_right(cum, next(draws), 0, last) if last else 0
            steps.append((w, a, c))
            probs.append(p[c])
            ids += pieces[c]
            a = nxt[c]


def sample(lat: Lattices, text: str, k: int, seed: int) -> list[tuple[list[int], float, float, float]]:
    """Up to ``k`` distinct segmentations as (ids, log-probability given the text, perturbed, inclusion score), best first.

    The inclusion score is the chance that a path is among the first k, given the threshold, the perturbed weight of
    the next path; it is 1 where there is no next one. An empty text has one segmentation, without pieces.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    tables = [lat.word(u) for u in _UNIT.findall(lat.model.normalize(text))]

    def draws():
        while True:
            yield from rng.random(256).tolist()

    stream = draws()
    out, heap, count = [], [], 0

    def split(path: _Path, first: int, key: float, gone: float, mass: float) -> None:
        """Nodes of what is left at each step from ``first`` on; ``gone``: probability taken out there; ``mass``: of the steps before."""
        nonlocal count
        p = np.array(path.probs[first:])
        if not len(p):
            return
        before = mass + np.concatenate([[0.0], np.cumsum(np.log(p[:-1]))])
        left = 1.0 - p
        left[0] -= gone
        ok = np.flatnonzero(left > 1e-12)
        if not len(ok):
            return
        phi = before[ok] + np.log(left[ok])
        keys = phi - np.log(np.exp(np.minimum(phi - key, 700.0)) + rng.exponential(size=len(ok)))
        for j in np.argsort(-keys, kind="stable")[: k + 1]:
            count += 1
            heapq.heappush(heap, (-float(keys[j]), count, path, first + int(ok[j]), float(before[ok[j]])))

    root = _Path()
    _descend(tables, root, 0, 0, stream)
    key = -math.log(rng.exponential())
    out.append((root, key))
    split(root, 0, key, 0.0, 0.0)
    while heap and len(out) < k:
        minus, _, path, at, mass = heapq.heappop(heap)
        w, a, c = path.steps[at]
        _, nxt, pieces, p = tables[w][a]
        taken = path.taken.setdefault(at, {c})
        open_ = [i for i in range(len(p)) if i not in taken]
        if not open_:
            continue
        total = sum(p[i] for i in open_)
        x, pick = next(stream) * total, open_[-1]
        for i in open_:
            x -= p[i]
            if x < 0:
                pick = i
                break
        new = _Path()
        new.steps, new.probs = path.steps[:at] + [(w, a, pick)], path.probs[:at] + [p[pick]]
        new.ids = [i for s in path.steps[:at] for i in tables[s[0]][s[1]][2][s[2]]] + list(pieces[pick])
        gone = sum(p[i] for i in taken)
        new.taken[at] = taken  # the step is shared: what one takes is gone for all
        taken.add(pick)
        _descend(tables, new, *((w, nxt[pick]) if nxt[pick] < len(tables[w]) else (w + 1, 0)), stream)
        out.append((new, -minus))
        split(new, at, -minus, gone, mass)
    bound = -heap[0][0] if heap else None
    found = []
    for path, key in out:
        logp = float(np.log(path.probs).sum()) if path.probs else 0.0
        found.append((path.ids, logp, key, 1.0 if bound is None else -math.expm1(-math.exp(min(logp - bound, 700.0)))))
    return found


def key_seed(values: tuple, seed: int) -> int:
    """A seed from a row's key values, the same in every task."""
    raw = "\x1f".join("" if v is None else str(v) for v in values).encode()
    return zlib.crc32(raw) << 64 | zlib.adler32(raw) << 32 | seed & 0xFFFFFFFF


def encode_sampled(rows: DataFrame, keys: list[str], text: str = "text", k: int = SAMPLES, seed: int = 0, model: str | None = None, theta: float = THETA) -> DataFrame:
    """``keys`` and ``sample, ids, log_prob, perturbed, inclusion`` for up to ``k`` segmentations of every row.

    A null text is taken as empty: one sample without ids. Rows of equal keys and text get equal samples. A key column named
    like a result is not allowed. An empty table gives no row; other columns are not read.
    """
    path = model or default_model()
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)

    def run(batches):
        lat = lattices(path, theta)
        names = [*keys, "sample", "ids", "log_prob", "perturbed", "inclusion"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                cols = [c.to_pylist() for c in part.columns[:-1]]
                at, out = [], []
                for i, t in enumerate(part.column(len(keys)).to_pylist()):
                    for j, s in enumerate(sample(lat, t or "", k, key_seed(tuple(c[i] for c in cols), seed))):
                        at.append(i)
                        out.append((j, *s))
                made = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64())
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns[:-1]), *(pa.array(c, t) for c, t in zip(made, kinds, strict=True))], names)

    return spread(rows.select(*keys, text)).mapInArrow(run, f"{fields}sample int, ids array<int>, log_prob double, perturbed double, inclusion double")


def decode(rows: DataFrame, ids: str = "ids", to: str = "decoded", model: str | None = None) -> DataFrame:
    """``rows`` with the text of the ``ids`` column added; null ids have a null text. A column named ``to`` is replaced."""
    path = model or default_model()
    keep = [c for c in rows.columns if c != to]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)

    def run(batches):
        sp = lattices(path, THETA).model
        for batch in batches:
            texts = [None if v is None else sp.decode(v) for v in batch.column(keep.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, to])

    return rows.select(*keep).mapInArrow(run, f"{fields}`{to}` string")
