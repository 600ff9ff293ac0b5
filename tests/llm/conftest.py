import random

import pytest

WORDS = [f"{a}{b}" for a in "ka le mo ri su ta ve zo an el".split() for b in "na po ri ste di lu men tor ga shi".split()]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, cls string, kept string, size long, distance double"


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "x", "q"]))
        if i % 17 == 16:
            out[-1] += ".\n" + rng.choice(WORDS).title()
    return " ".join(out)


@pytest.fixture(scope="session")
def awkward():
    """Rows with nulls, blank, repeated, near-equal and long texts, shared passages, equal keys."""
    rng = random.Random(5)
    base, passage, long = prose(rng, 220), prose(rng, 70), prose(rng, 30_000)
    near = base.split(" ")
    near[50] = "changed"
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \t\n "), (6, "one two"), (7, "One  TWO\n"), (8, prose(rng, 40) + " " + passage), (9, passage + " " + prose(rng, 90)),
        (10, prose(rng, 300)), (11, long), (12, prose(rng, 10) + " " + long), (13, "a b c d e " * 60), (14, "same " * 80), (None, base), (15, "é ü x \x0b y \x85 z"), (16, passage), (16, passage), (17, base.upper()),
    ]
    rows += [(20 + i, prose(rng, 60 + i)) for i in range(40)]
    return [(k, t, None if i == 3 else "en", None if i % 9 == 4 else f"s{i % 2}", len(t or ""), i, "c", "k", i, 0.5) for i, (k, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
