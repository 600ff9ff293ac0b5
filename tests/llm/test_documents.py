"""The operators on documents, on awkward rows, against plain versions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidelog.llm import jaccard, lm, packing, quality, sharding, substring, textkernel


def pairs(awkward):
    return [(r[0], r[1]) for r in awkward]


def test_kernel_words_and_hashes(awkward):
    import pyarrow as pa

    texts = [t for _, t in pairs(awkward)]
    data, offs = textkernel.buffers(pa.array(texts))
    w = textkernel.tokenize(data, offs)
    flat = [x for t in texts for x in brute.words(t)]
    assert [bytes(data[a : a + n]).decode() for a, n in zip(w.starts, w.lengths, strict=True)] == flat
    assert len({(h, x) for h, x in zip(w.hashes.tolist(), flat, strict=True)}) == len(set(flat)) == len(set(w.hashes.tolist()))
    up = textkernel.tokenize(*textkernel.buffers(pa.array(["ABC é"])), lower=True)
    assert up.hashes.tolist() == textkernel.tokenize(*textkernel.buffers(pa.array(["abc é"]))).hashes.tolist()
    x = np.arange(400, dtype=np.uint64)
    assert textkernel.slide_min(x, 41).tolist() == list(range(360))


def test_jaccard_join(docs, awkward, no_docs):
    got = [tuple(r) for r in jaccard.join(docs).collect()]
    want = brute.near(pairs(awkward))
    assert len(got) == len(awkward)
    assert {k: (n, c) for k, n, c in got if k is not None} == want
    assert [c for k, _, c in got if k is None] == [None]
    assert jaccard.join(no_docs).count() == 0


def test_jaccard_keeps_one_of_each_group(docs, awkward):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted(k for k, (_, c) in brute.near(pairs(awkward)).items() if k == c)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want


def test_a_group_of_near_copies_and_a_common_passage(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(1)
    base, passage = prose(rng, 120).split(" "), prose(rng, 30)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(rng, 60) + " " + passage) for i in range(150)]
    got = {r[0]: (r[1], r[2]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.near(rows)


def clusters(rng, n):
    """Groups of texts at all similarities, most pairs near the bound, with a passage that half of them share."""
    from tests.llm.conftest import prose

    passage, rows = prose(rng, 40), []
    for g in range(n):
        base = prose(rng, rng.randrange(8, 160)).split(" ")
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(9)}"
            rows.append((len(rows), " ".join(w) + (" " + passage if g % 2 else "")))
    return rows


@pytest.mark.parametrize("limits", [{}, {"LONG_LIST": 4, "MOST_PAIRS": 0, "COMMON": 10_000, "CELL": 100, "PAIRS": 2, "PIECE": 3, "BLOCK": 5}, {"LONG_LIST": 4, "MOST_PAIRS": 0, "STARS": 0, "MOST_BITS": 10}])
def test_jaccard_long_lists_blocks_and_full_filters(spark, monkeypatch, limits):
    import random

    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = clusters(random.Random(8), 50)
    got = {r[0]: (r[1], r[2]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.near(rows)


def test_jaccard_filters_of_all_orders_lose_no_pair():
    import random

    import pyarrow as pa

    rng = random.Random(9)
    texts = [t for _, t in clusters(rng, 40)]
    sets = list(jaccard.shingle_sets(*textkernel.buffers(pa.array(texts))))
    shift = 64 - 6 - 32
    common = np.unique(jaccard.token_id(sets[-1][:30], shift))
    fronts = [np.frombuffer(jaccard.fronts(u, common, shift), np.uint32).reshape(2, -1) for u in sets]
    links = stopped = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            through = jaccard.passes(len(x), len(y), fronts[i], fronts[j])
            if jaccard.alike(x, y):
                links += 1
                assert through
            stopped += not through
    assert links > 30 and stopped > 5000


def test_jaccard_plans_stay_small(docs, monkeypatch):
    """Each scan, shuffle and broadcast of a plan costs the driver buffers and threads, all at once."""
    from tidelog.llm import shared

    plans = {}
    for module in (jaccard, shared):
        def counted(df, name, write=module.table):
            text = df._jdf.queryExecution().executedPlan().toString()
            plans.setdefault(name, []).append((text.count("Scan parquet"), text.count("Exchange")))
            return write(df, name)

        monkeypatch.setattr(module, "table", counted)
    jaccard.keep_one(docs).collect()
    assert max(scans for of in plans.values() for scans, _ in of) <= 10, plans
    assert max(moves for of in plans.values() for _, moves in of) <= 12, plans
    # a table of links, then one of components, whatever the rounds
    assert len(plans["cc"]) == len(plans["components"])


def test_components_of_few_and_of_many_edges(spark, monkeypatch):
    import random

    from tidelog.llm import shared

    rng = random.Random(3)
    edges = [(-(10**12) + k, -(10**12) + k + 1) for k in range(200)]
    edges += [(7, 10**15 + k) for k in range(300)] + [(k, k) for k in range(5)] + [(50 + rng.randrange(900), 50 + rng.randrange(900)) for _ in range(500)]
    edges += [(b, a) for a, b in edges[::3]] + edges[::5]
    lead = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(lead)):
        before = dict(lead)
        for a, b in edges:
            if a != b:
                lead[a] = lead[b] = min(lead[a], lead[b])
        if lead == before:
            break
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(5)
    for few in (shared.FEW_EDGES, 0):
        monkeypatch.setattr(shared, "FEW_EDGES", few)
        got = [tuple(r) for r in shared.components(df).collect()]
        assert dict(got) == lead and len(got) == len(lead)
    assert shared.components(df.limit(0)).count() == 0


def test_jaccard_keeps_rows_that_share_a_key_but_not_a_text(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(10)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a, 0), (1, b, 1), (2, a + " x", 2), (2, c, 3), (3, "", 4), (3, "", 5), (4, b.upper(), 6), (5, c, 7), (5, c, 8), (None, a, 9), (2, c.upper(), 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _j_n int")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(r["_j_n"] for r in kept.collect())
    assert got in ([0, 1, 3, 4, 5, 9], [0, 1, 4, 5, 9, 10])
    assert jaccard.keep_one(spark.createDataFrame([(7, c, 1), (7, c, 2), (7, c, 2)], "doc_id long, text string, n int")).count() == 1


def test_substring_removal(docs, awkward, no_docs):
    out = substring.remove(docs)
    assert set(docs.columns) <= set(out.columns)
    rows = out.collect()
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=key) == sorted(brute.removed(pairs(awkward)), key=key)
    assert all(r["kept_text"] == r["text"] for r in rows if not r["n_removed"])
    assert substring.remove(no_docs).count() == 0


@pytest.mark.parametrize("limits", [{}, {"LEAST_BITS": 10, "MOST_BITS": 10}, {"COMMON": 2, "FLUSH": 500}])
def test_short_windows_against_brute_force(spark, monkeypatch, limits):
    """Also with a filter that is full, and with most minimisers common."""
    import random

    for name, value in limits.items():
        monkeypatch.setattr(substring, name, value)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove(df, k=8, m=3).collect())
    assert got == sorted(brute.removed(rows, 8))


def test_quality_statistics_and_verdict(docs, awkward, no_docs):
    out = quality.judge(docs)
    assert {"doc_id", "text", "n"} <= set(out.columns)
    for r in out.collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.statistics(r["text"])
        assert not (r["base_failed"] and r["kept"])
    assert out.count() == len(awkward)
    assert quality.judge(no_docs).count() == 0


def test_quality_rejects_outliers_of_a_group_and_keeps_the_rest(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(30, 900)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{w}***" for w in prose(rng, 150).split()), "en", "s") for i in range(60)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k, *_ in rows if k < 1000)
    assert not any(got[k] for k, *_ in rows if k >= 1000)


@pytest.mark.parametrize("copies", [150, 210])
def test_quality_rejects_junk_that_is_a_third_or_more_of_a_source(spark, copies):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(30, 900)), "en", "s") for i in range(300)]
    junk = " ".join(f"{w}*" for w in prose(rng, 150).split())
    rows += [(1000 + i, junk, "en", "s") for i in range(copies)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k, *_ in rows if k < 1000)
    assert not any(got[k] for k, *_ in rows if k >= 1000)


def test_quality_rejects_a_text_for_repeated_lines_or_windows_alone(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(30, 900)), "en", "s") for i in range(300)]
    lines = "\n".join(f"{prose(rng, 16)}\nnext page\nto top" for _ in range(15))
    part = prose(rng, 48).replace("\n", " ")
    windows = " ".join([prose(rng, 200), part, prose(rng, 200), part]).replace("\n", " ")
    rows += [(1000, lines, "en", "s"), (1001, windows, "en", "s")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1000]["n_dup_lines"] >= 28 and got[1000]["n_repeat_words"] < 50 and got[1001]["n_dup_lines"] == 0 and got[1001]["n_repeat_words"] >= 90
    assert not any(r["base_failed"] for r in got.values())
    assert [k for k in sorted(got) if not got[k]["kept"]] == [1000, 1001]


def test_quality_estimate_is_the_robust_one(spark):
    """The estimate of clean rows hardly moves when a quarter is replaced by gross outliers."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5)) * [1.0, 0.2, 1.0, 1.0, 1.0] + 3
    bad = x.copy()
    bad[:800, 2] += 40
    names = ", ".join(f"{c} double" for c in quality.SPREADS)
    fits = []
    for rows in (x, bad):
        df = spark.createDataFrame([(("en", "s"), *map(float, r)) for r in rows], f"g struct<_g_lang:string,_g_source:string>, {names}")
        fits.append(quality.estimates(df).first())
    for c in quality.SPREADS:
        assert abs(fits[0][f"m_{c}"] - fits[1][f"m_{c}"]) < 0.2
    assert fits[1]["l_2_2"] < 2.5
    assert quality.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_quality_concentration_against_all_halves(spark):
    """Of all halves of a small group, the one of least determinant: the steps come close, and both leave the outliers out."""
    from itertools import combinations

    rng = np.random.default_rng(6)
    x = rng.normal(size=(16, 5)) * [3.0, 1.0, 2.0, 2.0, 2.0] + [10.0, 8.0, 9.0, 9.0, 9.0]
    x[11:, 2] += 90
    halves = np.array(list(combinations(range(16), 8)))
    part = x[halves] - x[halves].mean(1, keepdims=True)
    cov = np.einsum("hni,hnj->hij", part, part) / 8
    dets = np.linalg.slogdet(cov)[1]
    best = int(dets.argmin())
    assert not set(halves[best]) & set(range(11, 16))
    factor = quality.SHARE / quality.chi_square_cdf(quality.chi_square_quantile(quality.SHARE, 5), 7)
    names = ", ".join(f"{c} double" for c in quality.XS)
    df = spark.createDataFrame([("g", *map(float, r), 3.0) for r in x], f"g string, {names}, x_lines double")
    got = quality.concentrated(df).first()
    assert got["m_x_sym"] < 30
    assert dets[best] + 5 * np.log(factor) - 1e-6 <= got["ld"] <= np.partition(dets, len(dets) // 20)[len(dets) // 20] + 5 * np.log(factor)
    made = quality.estimates(df).first()
    d2 = [sum(v * v for v in np.linalg.solve(np.array([[made[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)]), row - [made[f"m_{c}"] for c in quality.XS])) for row in x]
    assert [d > quality._limit() for d in d2] == [False] * 11 + [True] * 5


def test_quality_of_copies_and_of_tiny_groups(spark):
    """Copies of one text in most of a source don't make others outliers; sources and languages of few rows are judged too."""
    import random

    from tests.llm.conftest import prose

    rng = random.Random(11)
    copy = prose(rng, 200)
    rows = [(i, prose(rng, rng.randrange(30, 900)), "en", "s") for i in range(60)] + [(100 + i, copy, "en", "s") for i in range(400)]
    rows += [(1000 + i, prose(rng, rng.randrange(30, 900)), "en", f"t{i}") for i in range(6)] + [(2000, prose(rng, 300), None, None)]
    junk = " ".join(f"{w}***" for w in prose(rng, 150).split())
    rows += [(3000, junk, "en", "t0"), (3001, junk, "xx", "s"), (3002, junk, None, "u")]
    schema = "doc_id long, text string, lang string, source string, _qt string, _qb int, x_len double, g string, cut int"
    out = quality.judge(spark.createDataFrame([(*r, "a", 1, 2.0, "g", 3) for r in rows], schema))
    assert {"_qt", "_qb", "x_len", "g", "cut"} <= set(out.columns)
    got = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert {k for k, kept in got.items() if not kept} == {3000, 3001, 3002}
    assert {"_qt", "_qk"} <= set(quality.base_statistics(spark.createDataFrame([("a b", "c", 1)], "text string, _qt string, _qk int")).columns)


def test_sharding_law_of_bytes(docs, awkward, no_docs):
    rows = sharding.shard(docs, shards=5).collect()
    size = defaultdict(int)
    slots = defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = sum(len((t or "").encode()) + 8 for _, t in pairs(awkward))
    longest = max(len((t or "").encode()) + 8 for _, t in pairs(awkward))
    assert sum(size.values()) == whole and max(size.values()) <= max(longest, whole / 5 + 100)
    want = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in pairs(awkward))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shard(no_docs).count() == 0


def test_slot_map_versions(spark, tmp_path):
    loads = [(s * 7919) % 101 for s in range(512)]
    first = sharding.first_map(512, 6)
    second = sharding.rebalance(first, loads, 6)
    totals = lambda m, n: [sum(b for b, d in zip(loads, m, strict=True) if d == x) for x in range(n)]
    assert max(totals(second, 6)) - min(totals(second, 6)) <= 1
    third = sharding.grow(second, loads, 6)
    assert all(b in (a, 6) for a, b in zip(second, third, strict=True))
    assert max(totals(third, 7)) - min(totals(third, 7)) <= 101
    path = f"file://{tmp_path}/map"
    for v, m in enumerate((first, second, third)):
        sharding.save_map(sharding.map_table(spark, m, loads, v), path, v)
    assert sharding.mapping_of(sharding.load_map(spark, path)) == third
    assert sharding.mapping_of(sharding.load_map(spark, path, 1)) == second
    with pytest.raises(Exception, match="exists"):
        sharding.save_map(sharding.map_table(spark, first, loads, 2), path, 2)


def test_sharding_edits_and_reads_a_stored_map(spark, tmp_path):
    """Placed as a plain version places by the newest stored map; a second table edits it; sizes differ by less than the smallest row."""
    rows = [(i, "x" * ((i * 7919) % 997)) for i in range(3000)]
    path = f"file://{tmp_path}/map"
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=5, slots=512, path=path).collect()
    assert {r["version"] for r in spark.read.parquet(path).select("version").distinct().collect()} == {1, 2}
    mapping = sharding.mapping_of(sharding.load_map(spark, path))
    total = Counter()
    for r in got:
        assert r["shard"] == mapping[r["vslot"]]
        total[r["shard"]] += r["size"]
    assert max(total.values()) - min(total.values()) <= 1
    assert sum(total.values()) == sum(len(t) + 8 for _, t in rows)
    more = [(i, "y" * 500) for i in range(5000, 5100)]
    sharding.shard(spark.createDataFrame(rows + more, "doc_id long, text string"), shards=5, slots=512, path=path).count()
    later = sharding.load_map(spark, path)
    assert later.first()["version"] == 3
    moved = sum(a != b for a, b in zip(mapping, sharding.mapping_of(later), strict=True))
    assert 0 < moved < 100


def test_sharding_spreads_rows_without_a_key(spark):
    rows = [(None, f"text {i}") for i in range(1000)]
    got = Counter(r["shard"] for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect())
    assert len(got) == 4 and max(got.values()) - min(got.values()) < 30


def test_packing_ids_pieces_and_places(docs, awkward, no_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs, capacity=512).collect()
    want = Counter()
    for k, t in pairs(awkward):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, (s, n) in enumerate(packing.cut(len(ids), 512)):
            want[k, p, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert [a for a, _ in spans] == list(np.cumsum([0, *[n for _, n in spans][:-1]]))
        assert sum(n for _, n in spans) <= 512
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // 512) + 2
    assert packing.pack(no_docs).count() == 0


def test_packing_of_long_white_space_and_of_full_pieces(spark):
    from tokenizers import Tokenizer

    tok, path = Tokenizer.from_file(packing.default_tokenizer()), packing.default_tokenizer()
    for t in [" " * 2_000_000, "x" + "\n" * 2_000_000 + " y", "a" * 2_000_000, "1" * 2_000_000]:
        assert packing.token_ids(path, t).tolist() == tok.encode(t, add_special_tokens=False).ids
    rows = [(i, " ".join(["word"] * n)) for i, n in enumerate([400, 130, 63, 63, 64, 5, 127, 127])]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert [a for a, _ in spans] == list(np.cumsum([0, *[n for _, n in spans][:-1]])) and sum(n for _, n in spans) <= 64
    assert len(by) == -(-sum(r["length"] for r in got) // 64)


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_uses_every_piece(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(513, np.int64)
    np.add.at(hist, np.clip(rng.lognormal(4.5, 1.0, 5000).astype(int), 1, 512), 1)
    done = packing.plan(hist, 512)
    used = np.zeros(513, np.int64)
    for lengths, n in done:
        assert sum(lengths) <= 512
        for v in lengths:
            used[v] += n
    assert (used == hist).all()
    assert sum(n for _, n in done) <= 1.01 * (hist * np.arange(513)).sum() / 512 + 1


def test_tokenizer_equals_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    for t in ["", " ", "a  b\n\n c", "don't I'LL", "naïve Ünï 中文 😀‍", "\x00\x01\t\r\n", "<|endoftext|>x", "1234567 8.9", "a" * 5000, "¡¿«»" * 9]:
        assert enc.encode(t, allowed_special="all") == tok.encode(t, add_special_tokens=False).ids


def test_language_model_counts_and_scores(docs, awkward, no_docs):
    rows = lm.score(docs).collect()
    tokens = [(k, [*(w.translate(brute.LOWER) for w in brute.words(t)), None]) for k, t in pairs(awkward)]
    count = Counter(x for k, ws in tokens if k is not None and lm.fold(k) != 2 for x in ws)
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for k, ws in tokens:
        base = sum(np.log10((count[x] + 1) / (total + distinct + 1)) for x in ws)
        want[k, k is not None and lm.fold(k) == 2, len(ws), sum(count[x] > 0 for x in ws), total, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert lm.score(no_docs).count() == 0


def test_language_model_is_a_distribution_and_beats_its_base_on_held_out_text(spark):
    import random

    rng = random.Random(4)
    nxt = {w: [rng.choice("abcdefghij") for _ in range(3)] for w in "abcdefghij"}

    def text():
        w = [rng.choice("abcdefghij")]
        while len(w) < 60:
            w.append(rng.choice(nxt[w[-1]]))
        return " ".join(w)

    rows = lm.score(spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")).where("held_out")
    r = rows.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r["s"] / r["n"] > r["b"] / r["n"] + 0.3
    w = lm.learn([(3, 10, 20, 100), (3, 0, 20, 5), (5, 4, 30, 50)], 0.01)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[5, 0] > 0.5
