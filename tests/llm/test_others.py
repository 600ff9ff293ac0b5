"""HTML, chat, segmentations, embeddings, the pipeline and the SQL of the training-data queries."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tidelog.llm import embeddings, html, preferences, segmentation
from tidelog.llm.oracles import ORACLES
from tidelog.llm.queries import QUERIES
from tidelog.llm.shared import components

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul></nav><div class="cookie-notice"><p>We use cookies, as all do, and so on, and on.</p></div>
<div id="wrap"><div class="sidebar"><p>Side text, which is long enough, to score points, right here, in the bar.</p></div>
<div class="content"><h2>Title &amp; more</h2><p>First <b>para</b>graph, with commas, and enough text to count as a paragraph of the article.</p><!-- <p>no</p> --><div class="ad-box">Buy, buy, buy.</div>
<p>Sec<i>ond</i> paragraph&nbsp;here,\n which goes on, and on, and is also long enough.<p>Third, left open<ul><li><a href="x">link</a></li></ul></div>
<div id="comments"><article><p>Nice post, really, I liked it a lot, and I want to say, thank you so much, for all.</p></article></div></div>
<form><p>Name, address, this is a form text that is long enough, is it</p></form><footer>&copy; me</footer></body></html>"""


def test_html_keeps_the_article_only():
    assert html.main_text(PAGE) == "Title & more First paragraph, with commas, and enough text to count as a paragraph of the article. Second paragraph here, which goes on, and on, and is also long enough. Third, left open"
    assert html.main_text("a < b &lt; c") == "a < b < c"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> </p>") == ""


def test_html_class_of_a_wrapper_does_not_count_against_its_article():
    inner = "<div class='layout sidebar-left'><article><h1>Head</h1><p>A text of some length, with commas, to be kept whole, whatever the wrapper is called.</p></article><div class='sidebar'>no</div></div>"
    assert html.main_text(inner).startswith("Head A text") and "no" not in html.main_text(inner).split()
    alone = "<div class='modal'><p>All there is on this page is in here, and it is long enough, so it is kept.</p></div>"
    assert html.main_text(alone).startswith("All there is")


def test_html_reads_broken_and_deep_pages_in_linear_time():
    for page in ("<div>" * 50_000, '<a "' * 50_000, "<p>" + "x, " * 200_000, "<header>" * 50_000, "<ul><li>" * 30_000, "<b>" * 30_000 + "</i>" * 30_000, "<" * 50_000, "<li><ul>" + "<div>" * 25_000 + "<li>" * 25_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000):
        html.main_text(page)


def para(k):
    return f"Paragraph {k} has some text, with commas in it, and is long enough to be one of an article."


BODY = "<h1>Head</h1>" + "".join(f"<p>{para(k)}</p>" for k in range(3))
TEXT = " ".join(["Head", *(para(k) for k in range(3))])
SECTIONS = "".join(f"<section><div><div><div><p>{para(k)}</p><p>{para(k + 10)}</p></div></div></div></section>" for k in range(6))


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><form><div>{BODY}</div></form></body>", TEXT),
    (f"<body><div><p>{para(70)}</p></div><form id=aspnetForm><article>{BODY}</article></form></body>", TEXT),
    (f"<body><div class='panel-discussion'><article>{BODY}</article></div></body>", TEXT),
    (f"<body><article class='post comments-open'>{BODY}</article></body>", TEXT),
    (f"<body><section id='discussion'>{BODY}</section></body>", TEXT),
    (f"<body><header><h1>Site</h1></header><div>Skip</div><form>{BODY.replace('h1', 'h2')}</form></body>", TEXT),
    (f"<body><div>{SECTIONS}</div></body>", " ".join(f"{para(k)} {para(k + 10)}" for k in range(6))),
    (f"<body><article>{BODY}<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article></body>", f"{TEXT} one two three"),
    (f"<body><div><ul><li><a href=1>menu</a></ul>{BODY}</div></body>", TEXT),
    (f"<body><article><h1>Short</h1><p>{para(1)}</p></article><div id=comments>{''.join(f'<article><h4>me</h4><p>{para(k)}</p></article>' for k in range(50, 60))}</div></body>", f"Short {para(1)}"),
    (f"<body><div><article>Tiny, but all.</article></div><div class='ad'>{para(4)}</div></body>", "Tiny, but all."),
    (f"<body><div><i><b><u>{para(1)}</u></b></i><li><div><div>{para(2)}</div><li>{para(3)}</div></body>", f"{para(1)} {para(2)} {para(3)}"),
])
def test_html_structure_decides(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("seed", range(30))
def test_html_of_generated_pages(seed):
    """Pages put together at random, with the text of their article known."""
    rng = random.Random(seed)
    blocks = [(rng.choice(["p", "p", "p", "blockquote", "pre", "h2"]), f"{para(k)} {'more, and more. ' * rng.randrange(9)}".strip()) for k in range(rng.randrange(2, 12))]
    body = "<h1>Head</h1>" + "".join(f"<{t}>{rng.choice(['', ' ', chr(10)])}{x}</{t}>" for t, x in blocks)
    want = " ".join(["Head", *(x for _, x in blocks)])
    kind = rng.randrange(3)
    body = f"<article>{body}</article>" if kind == 0 else f"<main><div>{body}</div></main>" if kind == 1 else f"<div class=text>{body}</div>"
    for _ in range(rng.randrange(4)):
        body = rng.choice(["<div>{}</div>", "<div class='modal-page'>{}</div>", "<form>{}</form>", "<div class='has-sidebar'>{}</div>", "<section>{}</section>"]).format(body)
    around = [f"<nav>{para(90)}</nav>", f"<div class='sidebar'>{para(91)}</div>", f"<div class='cookie-notice'>{para(92)}</div>", f"<div id='comments'><p>{para(93)}</p><p>{para(94)}</p></div>", "<ul><li><a href=1>a</a><li><a href=2>b</a></ul>", f"<footer>{para(95)}</footer>", f"<aside>{para(96)}</aside>", f"<script>{para(97)}</script>", f"<div style='display: none'>{para(98)}</div>"]
    rng.shuffle(around)
    cut = rng.randrange(len(around))
    assert html.main_text("<html><body>" + "".join(around[:cut]) + body + "".join(around[cut:]) + "</body></html>") == want


def test_html_operator(spark):
    rows = [(1, "u", PAGE, "t", 5), (2, None, None, "t", 5), (None, "u", "", "t", 5), (1, "u", PAGE, "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string, other int")
    got = html.extract(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sorted(r["n_chars"] for r in got) == sorted([0, 0, len(html.main_text(PAGE)), len(html.main_text(PAGE))])
    assert html.extract(df.where("page_id > 9")).count() == 0


TURNS = "pair_id long, side int, turn long, role string, text string, at string, part int, fork string, said int, LEAD int"


def chat(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, "f", 1, 2) for r in rows], TURNS)


def test_preferences_share_the_common_prefix_once(spark):
    rows = [
        (1, 0, 0, "system", "be"), (1, 1, 0, "system", "be"), (1, 0, 1, "user", "hi"), (1, 1, 1, "user", "hi"), (1, 0, 2, "assistant", "good"), (1, 1, 2, "assistant", "bad <|x"), (1, 0, 3, "user", "bye"),
        (2, 0, 0, "user", "a"), (3, 0, 0, "user", None), (3, 1, 0, None, ""), (4, 0, 0, "user", "q"), (4, 1, 0, "user", "q"), (None, 0, 0, "user", "q"),
    ]
    got = {r["pair_id"]: r for r in preferences.format_pairs(chat(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert one["prompt"] == "<|system|>\nbe\n<|end|>\n<|user|>\nhi\n<|end|>\n" and one["n_prompt_turns"] == 2
    assert one["rejected"] == "<|assistant|>\nbad < |x\n<|end|>\n"
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["good\n<|end|>\n"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_mask"]] == ["bad < |x\n<|end|>\n"]
    assert (got[2]["prompt"], got[2]["rejected"]) == ("", "")
    assert (got[4]["chosen"], got[4]["rejected"], got[4]["n_prompt_turns"]) == ("", "", 1)
    assert preferences.format_pairs(chat(spark, [])).count() == 0


def test_preferences_of_swapped_answers(spark):
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"), (0, 3, "assistant", "b0"), (0, 4, "user", "bye"), (1, 0, "user", "q1"), (1, 1, "assistant", None), (2, 0, "user", "alone"), (4, 0, "assistant", "x"), (5, 0, "assistant", "x"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, fork int, side int")
    made = preferences.swapped(df)
    assert sorted((r["pair_id"], r["side"], r["turn"], r["text"]) for r in made.collect() if r["pair_id"] == 0) == [(0, 0, 0, "q0"), (0, 0, 1, "a0"), (0, 0, 2, "more"), (0, 0, 3, "b0"), (0, 0, 4, "bye"), (0, 1, 0, "q0"), (0, 1, 1, "a0"), (0, 1, 2, "more"), (0, 1, 3, ""), (0, 1, 4, "bye")]
    got = {r["pair_id"]: r for r in preferences.format_pairs(made).collect()}
    assert {k: r["n_prompt_turns"] for k, r in got.items()} == {0: 3, 1: 1, 2: 1, 4: 1, 5: 1}
    assert got[1]["rejected"] == "<|assistant|>\nb0\n<|end|>\n" and got[1]["chosen"] == "<|assistant|>\n\n<|end|>\n"
    assert got[4]["chosen"] == got[4]["rejected"] == ""


def test_preferences_query_shares_most_turns(spark, sf_dir):
    r = QUERIES["op2_preference_formatting"](spark, sf_dir).selectExpr("count(*) AS n", "count_if(n_prompt_turns > 0) AS p", "count_if(chosen <> '' AND rejected <> '') AS c").first()
    assert r["p"] > 0.9 * r["n"] and r["c"] > 0.6 * r["n"]


@pytest.fixture(scope="module")
def lat():
    return segmentation.lattices(segmentation.default_model(), 0.3)


def every(lat, text):
    """All segmentations of a text with their probabilities."""
    out = {(): 1.0}
    for unit in segmentation._UNIT.findall(lat.model.normalize(text)):
        table, todo, mine = lat.word(unit), [(0, (), 1.0)], {}
        while todo:
            a, ids, p = todo.pop()
            if a == len(table):
                mine[ids] = p
                continue
            todo += [(n, ids + x, p * q) for n, x, q in zip(table[a][1], table[a][2], table[a][3], strict=True)]
        out = {k + i: p * q for k, p in out.items() for i, q in mine.items()}
    return out


def test_samples_are_distinct_and_drawn_without_replacement(lat):
    exact = every(lat, "in er")
    assert sum(exact.values()) == pytest.approx(1)
    first, second, estimate, n = Counter(), Counter(), Counter(), 4000
    for seed in range(n):
        got = segmentation.sample(lat, "in er", 3, seed)
        keys = [tuple(g[0]) for g in got]
        assert len(set(keys)) == 3 and [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        assert all(math.exp(g[1]) == pytest.approx(exact[tuple(g[0])]) for g in got)
        first[keys[0]] += 1
        second[keys[0], keys[1]] += 1
        for g in got:
            estimate[tuple(g[0])] += math.exp(g[1]) / g[3]
    for k, p in exact.items():
        assert first[k] / n == pytest.approx(p, abs=0.03)
        for j, q in exact.items():
            if j != k:
                assert second[k, j] / n == pytest.approx(p * q / (1 - p), abs=0.03)
    assert sum(estimate.values()) / n == pytest.approx(1, abs=0.05)


def test_all_segmentations_come_out_when_there_are_few(lat):
    exact = every(lat, "ab")
    got = segmentation.sample(lat, "ab", 1000, 1)
    assert {tuple(g[0]) for g in got} == set(exact) and all(g[3] == 1.0 for g in got)
    assert segmentation.sample(lat, "", 3, 1)[0][0] == []


def test_segmentation_operator_round_trip(spark):
    texts = [None, "", " two  spaces ", "日本語 ﬁ \x00 é😀", "plain words here", "x" * 3000, "plain words here"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "k long, text string, seed int")
    rows = segmentation.decode(segmentation.encode_sampled(df, ["k"], k=3)).collect()
    for r in rows:
        assert r["decoded"] == (texts[r["k"]] or "")
    assert Counter(r["k"] for r in rows)[0] == 1 and Counter(r["k"] for r in rows)[4] == 3
    again = {(r["k"], r["sample"]): r["ids"] for r in segmentation.encode_sampled(df.repartition(4), ["k"], k=3).collect()}
    assert again == {(r["k"], r["sample"]): r["ids"] for r in rows}
    assert segmentation.encode_sampled(df.where("k > 99"), ["k"]).count() == 0


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centre[i % 12] + rng.normal(size=16) * (0.25 if i % 3 else 0.02)], int(i % 2)) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] + [1.0] * 15, 0), (2003, [None] + [1.0] * 15, 0), (2004, [], 0), (2005, rows[0][1], None), (2006, rows[0][1][:8], 0), (2007, [1e300 * x for x in rows[0][1]], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, 7, "c") for r in rows], "vec_id long, embedding array<double>, label int, n int, cls string")
    want = brute.cosine_links([r for r in rows if r[0] != 2007], 0.93)
    huge = want[0]
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows) and got[None]["component_id"] is None
    assert (got[2007]["n_links"], got[2007]["component_id"]) == (huge[0] + 1, huge[1])
    linked = {i for i, (_, c) in want.items() if c == huge[1]}
    for i, (n, c) in want.items():
        assert got[i]["component_id"] == c and got[i]["kept"] == (c == i)
        if i not in linked:
            assert got[i]["n_links"] == n
    assert embeddings.near_duplicates(df.where("vec_id > 5000")).count() == 0


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_pipeline_stages_against_plain_versions(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    one = p.quality_rules(spark, docs, sf_dir).collect()
    passed = {k for k, t in rows.items() if not brute.statistics(t)[-1]}
    kept = {r["doc_id"] for r in one}
    assert kept <= passed and len(kept) > 0.8 * len(passed)
    df = spark.createDataFrame(one, docs.schema)
    two = p.near_duplicates(spark, df, sf_dir).collect()
    near = brute.near([(k, rows[k]) for k in kept])
    assert {r["doc_id"] for r in two} == {k for k, (_, c) in near.items() if c == k}
    df = spark.createDataFrame(two, docs.schema)
    three = p.substring_dedup(spark, df, sf_dir).collect()
    want = {k: (n, g) for k, n, g, _ in brute.removed([(r["doc_id"], r["text"]) for r in two])}
    assert {r["doc_id"] for r in three} == {k for k, (n, g) in want.items() if g == 0 or g < n}
    for r in three:
        n, g = want[r["doc_id"]]
        assert len(brute.words(r["text"])) == n - g
    four = p.best_fit_packing(spark, spark.createDataFrame(three, docs.schema), sf_dir).collect()
    assert {r["doc_id"] for r in four} == {r["doc_id"] for r in three}
    assert p.run(spark, sf_dir).count() == len(four)
