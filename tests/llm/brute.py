"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows):
    """{key: (set size, smallest reachable key)} of rows with a key."""
    sets = {k: shingles(t) for k, t in rows if k is not None}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {k: (len(sets[k]), find(k)) for k in keys}


def removed(rows, k=50):
    """[(key, words, removed, checksum)] of every row."""
    owner = {}
    for key, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if key is not None:
                owner[g] = min(owner.get(g, key), key)
    out = []
    for key, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if key is not None and owner[tuple(w[i : i + k])] < key:
                gone[i : i + k] = [True] * k
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((key, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def statistics(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            cover.update(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), failed


def cosine_links(rows, bound):
    """{id: (links, smallest reachable id)} for rows (id, vector, label)."""
    import numpy as np

    ok = [(i, np.array(v, float), la) for i, v, la in rows if i is not None and la is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = defaultdict(set)
    for x, (i, u, a) in enumerate(ok):
        for y, (j, v, b) in enumerate(ok):
            if x != y and a == b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= bound:
                near[i].add((j, y))
    out = {}
    for i, _, _ in rows:
        if i is None:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j, _ in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near[i]), min(seen))
    return out
