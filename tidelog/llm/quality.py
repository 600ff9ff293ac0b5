"""Quality rules with robust multivariate outlier rejection, in DataFrame functions only.

Base statistics come from one pass over the whole texts. The verdict beyond the base rules is robust:
for each language and source the mean and scatter of the half of the rows whose scatter has the least determinant
are sought by concentration steps from several starts, until the determinant settles. The estimate is then taken again from all rows
it would not reject, and rows far from that by Mahalanobis distance go. Copies of one text are one row to
the estimates. A source's estimate is drawn to its language's, and that to the whole table's, as if by PRIOR_ROWS more
rows, so small groups need no rule of their own.

Many groups have no symbols or repeats in most rows, and no variance there. A statistic that varies by less than a few counts
do in a row of the group's own median length is given that spread instead; so the spread follows the group.

A step is two small aggregates per group (a histogram of distances, then sums and cross-products of the rows in
the closest part), both combined map-side, so a group that holds a third of all rows costs no more
than others and nothing is ever collected per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import discard, table

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Share of a group's rows that the estimate rests on (half, so that it holds while fewer than half are outliers), starts,
#: steps from every start, and steps at most; the log of the determinant has settled when it falls below all before by less.
SHARE, STARTS, FIRST_STEPS, STEPS, SETTLED = 0.5, 3, 2, 10, 0.1
#: Rows that a start other than the first is drawn from; rows that a parent group's estimate counts for.
DRAWN, PRIOR_ROWS = 60, 25
#: A clean row is rejected once in so many, were the statistics normal.
ODDS = 1e8
#: Words added to a row's own before a rate is taken, so that short texts don't scatter.
PRIOR_WORDS = 100.0
#: Transformed statistics, and what alone never rejects a row of its group's median length: a text twice as long, half a
#: character more a word, so many symbols, so many repeated lines, so many words in repeated windows.
SPREADS = {"x_len": 2.0, "x_char": 0.5, "x_sym": 15, "x_line": 5, "x_rep": 75}


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` added.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have zeros and fail. Working columns start
    with ``_q`` and are dropped; an input column named like a result is replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = [c for c in docs.columns if c not in names]
    body = F.coalesce(F.col(text), F.lit(""))
    # the input's columns travel in one, so that none meets a working column
    df = docs.select(F.struct(F.lit(0).alias("_q0"), *(docs[c] for c in kept)).alias("_qrow"), body.alias("_qt")).withColumn("_qb", F.btrim("_qt", F.lit(WHITE)))
    df = df.withColumn("_qw", F.when(F.col("_qb") == "", F.array().cast("array<string>")).otherwise(F.split("_qb", r"[\x20\x09-\x0D]+")))
    # a key for each window of five words; a text without five has none
    df = df.withColumn("_qk", F.expr("CASE WHEN size(_qw) >= 5 THEN transform(sequence(0, size(_qw) - 5), i -> xxhash64(_qw[i], _qw[i+1], _qw[i+2], _qw[i+3], _qw[i+4])) ELSE cast(array() AS array<bigint>) END"))
    df = df.withColumn("_qbits", F.expr("CASE WHEN size(array_distinct(_qk)) < size(_qk) THEN length(bin(size(_qk))) ELSE 0 END"))
    # only for texts that repeat a window: keys sorted with their place in the low bits, then places with an equal neighbour
    df = df.withColumn("_qp", F.expr("CASE WHEN _qbits > 0 THEN transform(sort_array(transform(_qk, (h, i) -> shiftleft(h, _qbits) | cast(i AS bigint))), x -> cast(x & (shiftleft(1L, _qbits) - 1) AS int)) ELSE cast(array() AS array<int>) END"))
    df = df.withColumn("_qr", F.expr("sort_array(filter(_qp, (p, j) -> (j > 0 AND _qk[p] = _qk[_qp[greatest(j - 1, 0)]]) OR (j < size(_qp) - 1 AND _qk[p] = _qk[_qp[least(j + 1, size(_qp) - 1)]])))"))
    df = df.withColumn("_ql", F.expr(r"filter(split(_qt, '\n'), l -> btrim(l, ' \t\n\u000b\u000c\r') <> '')"))
    df = df.select(
        *(F.col("_qrow")[c].alias(c) for c in kept),
        F.size("_qw").cast("long").alias("n_words"),
        F.length(F.translate("_qt", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_qt") - F.length(F.translate("_qt", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr("cast(size(_ql) - size(array_distinct(_ql)) AS bigint)").alias("n_dup_lines"),
        F.expr("cast(CASE WHEN size(_qr) = 0 THEN 0 ELSE 5 + aggregate(_qr, named_struct('s', 0, 'p', _qr[0]), (a, p) -> named_struct('s', a.s + least(5, p - a.p), 'p', p), a -> a.s) END AS bigint)").alias("n_repeat_words"),
        F.size("_ql").cast("long").alias("_qn_lines"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def transformed(df: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds the group and the transformed statistics: logs of the length and of smoothed rates."""
    w = F.col("n_words") + F.lit(PRIOR_WORDS)

    def rate(c: str) -> Column:
        return F.log1p(100.0 * F.col(c) / w)

    lines = F.log1p(100.0 * F.col("n_dup_lines") / (F.col("_qn_lines") + 10.0))
    mean = (F.col("word_chars") + 5.0 * PRIOR_WORDS) / w
    none = F.lit("\x00")
    return df.select(
        "*", F.coalesce(F.col(lang), none).alias("_g_lang"), F.coalesce(F.col(source), none).alias("_g_source"), F.log1p("n_words").alias("x_len"),
        F.log(mean).alias("x_char"), rate("n_symbols").alias("x_sym"), lines.alias("x_line"), rate("n_repeat_words").alias("x_rep"), F.log1p("_qn_lines").alias("x_lines"),
    )


def chi_square_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma P(k/2, x/2), by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while abs(term) > 1e-16 * abs(total):
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi_square_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid > 0 and chi_square_cdf(mid, k) < p else (lo, mid) if mid > 0 else (mid, hi)
    return hi


XS = list(SPREADS)
PAIRS = [(i, j) for i in range(len(XS)) for j in range(i + 1)]


def _limit() -> float:
    return chi_square_quantile(1 - 1 / ODDS, len(XS))


def _bin(d: str) -> Column:
    return F.floor(100 * F.log1p(F.least(F.col(d), F.lit(1e12))))


def _factored(model: DataFrame) -> DataFrame:
    """Adds the Cholesky factor ``l_i_j`` of the scatter ``s_i_j`` and ``ld``, the log of its determinant.

    Where the statistics before leave a variance below that of the counts in SPREADS, at the group's centre, it is raised to that.
    """
    words = F.greatest(F.expm1("m_x_len"), F.lit(0.0)) + PRIOR_WORDS
    lines = F.greatest(F.expm1("m_x_lines"), F.lit(1.0)) + 10.0
    counts = {
        "x_len": F.log(F.lit(SPREADS["x_len"])), "x_char": F.log1p(SPREADS["x_char"] / F.exp("m_x_char")), "x_sym": F.log1p(100.0 * SPREADS["x_sym"] / words),
        "x_line": F.log1p(100.0 * SPREADS["x_line"] / lines), "x_rep": F.log1p(100.0 * SPREADS["x_rep"] / words),
    }
    for i, j in PAIRS:
        rest = F.col(f"s_{i}_{j}")
        for t in range(j):
            rest = rest - F.col(f"l_{i}_{t}") * F.col(f"l_{j}_{t}")
        model = model.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, counts[XS[i]] ** 2 / _limit())) if i == j else rest / F.col(f"l_{j}_{j}"))
    ld = F.lit(0.0)
    for i in range(len(XS)):
        ld = ld + 2 * F.log(f"l_{i}_{i}")
    return model.withColumn("ld", ld)


def _moments(near: DataFrame, key: list[str], factor: float) -> DataFrame:
    """``(key, n, before, m_*, s_i_j, l_i_j, ld)`` of rows joined to their group's centre ``m_*`` and ``ld``; ``before``: the least one so far."""
    # sums about the centre, so that the products lose no digits
    c = {x: F.col(x) - F.col(f"m_{x}") for x in XS}
    sums = near.groupBy(*key).agg(
        F.count("*").alias("n"), F.least(F.first("ld"), F.first("before")).alias("before"), F.first("m_x_lines").alias("m_x_lines"), *(F.first(f"m_{x}").alias(f"o_{x}") for x in XS), *(F.avg(c[x]).alias(f"a_{x}") for x in XS),
        *(F.avg(c[XS[i]] * c[XS[j]]).alias(f"p_{i}_{j}") for i, j in PAIRS),
    )
    made = sums.select(
        *key, "n", "before", "m_x_lines", *((F.col(f"o_{x}") + F.col(f"a_{x}")).alias(f"m_{x}") for x in XS),
        *((factor * (F.col(f"p_{i}_{j}") - F.col(f"a_{XS[i]}") * F.col(f"a_{XS[j]}"))).alias(f"s_{i}_{j}") for i, j in PAIRS),
    )
    return _factored(made)


def _starts(rows: DataFrame) -> DataFrame:
    """``(g, k, size, ...)``: models to start from. Start 0: medians and quartile ranges; others: some rows drawn by a hash."""
    names = [*XS, "x_lines"]
    long = rows.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * 200).alias("b")) for i, x in enumerate(names)))).alias("e"))
    bins = long.groupBy("g", "e.i", "e.b").agg(F.count("*").alias("n"))
    each = W.Window.partitionBy("g", "i")
    run = bins.select("g", "i", "b", F.sum("n").over(each.orderBy("b")).alias("c"), F.sum("n").over(each).alias("size"))
    at = {q: F.min(F.when(F.col("c") >= q * F.col("size"), (F.col("b") + 0.5) / 200)) for q in (0.25, 0.5, 0.75)}
    mid = run.groupBy("g", "i").agg(F.first("size").alias("size"), at[0.5].alias("m"), ((at[0.75] - at[0.25]) / 1.349).alias("s"))
    wide = mid.groupBy("g").agg(F.max("size").alias("size"), *(F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"m_{x}") for i, x in enumerate(names)), *(F.max(F.when(F.col("i") == i, F.col("s") * F.col("s"))).alias(f"v_{i}") for i in range(len(XS))))
    first = table(_factored(wide.select("g", "size", *(f"m_{x}" for x in names), *((F.col(f"v_{i}") if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in PAIRS))).withColumn("before", F.lit(1e300)), "mcd")
    drawn = rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(1, STARTS))))).join(first, "g")
    drawn = drawn.where(F.pmod(F.xxhash64("k", *XS), F.lit(1_000_000)) * F.col("size") < DRAWN * 1_000_000)
    more = _moments(drawn, ["g", "k"], 1.0).withColumn("before", F.lit(1e300)).join(first.select("g", "size"), "g")
    cols = ["g", "k", "size", "before", "m_x_lines", *(f"m_{x}" for x in XS), *(f"l_{i}_{j}" for i, j in PAIRS), "ld"]
    return first.withColumn("k", F.lit(0)).select(*cols).unionByName(more.select(*cols))


def _step(rows: DataFrame, model: DataFrame, key: list[str]) -> DataFrame:
    """A concentration step: the moments of the SHARE of each group's rows that is closest to its model."""
    factor = SHARE / chi_square_cdf(chi_square_quantile(SHARE, len(XS)), len(XS) + 2)
    far = rows.join(model, key).withColumn("d", distance())
    bins = far.groupBy(*key, _bin("d").alias("b")).agg(F.count("*").alias("n"))
    each = W.Window.partitionBy(*key)
    run = bins.select(*key, "b", F.sum("n").over(each.orderBy("b")).alias("c"), F.sum("n").over(each).alias("all"))
    cuts = run.where(F.col("c") >= SHARE * F.col("all")).groupBy(*key).agg(F.min("b").alias("cut"))
    cut = table(model.join(cuts, key), "mcd_cut")
    near = rows.join(cut, key).withColumn("d", distance()).where(_bin("d") <= F.col("cut"))
    made = table(_moments(near, key, factor).join(model.select(*key, "size"), key), "mcd")
    discard(cut)
    return made


def concentrated(rows: DataFrame) -> DataFrame:
    """``(g, size, m_*, s_i_j, l_i_j, ld)``: the half of each group whose scatter has the least determinant found.

    All starts take FIRST_STEPS steps, the one of least determinant goes on until it settles.
    """
    key = ["g", "k"]
    model = table(_starts(rows), "mcd")
    several = rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(STARTS)))))
    for _ in range(FIRST_STEPS):
        before, model = model, _step(several, model, key)
        discard(before)
    best = model.groupBy("g").agg(F.min(F.struct("ld", "k")).alias("best"))
    before, model = model, table(model.join(best, "g").where("k = best.k").drop("k", "best"), "mcd")
    discard(before)
    for _ in range(STEPS - FIRST_STEPS):
        before, model = model, _step(rows, model, ["g"])
        discard(before)
        if (model.agg(F.max(F.col("before") - F.col("ld"))).first()[0] or 0.0) < SETTLED:
            break
    return model


def estimates(rows: DataFrame) -> DataFrame:
    """``(g, size, m_*, s_i_j, l_i_j)``: centre, scatter and its Cholesky factor for each group ``g``.

    ``rows`` has ``g``, the transformed statistics and, if known, ``x_lines``, the log of a row's lines. The rows that
    the concentrated half would not reject make the estimate.
    """
    if "x_lines" not in rows.columns:
        rows = rows.withColumn("x_lines", F.greatest(F.col("x_len") - 3.0, F.lit(0.0)))
    model = concentrated(rows)
    near = rows.join(model, "g").withColumn("d", distance()).where(F.col("d") <= _limit())
    made = _moments(near, ["g"], 1.0).join(model.select("g", "size"), "g")
    return table(made.drop("n", "before"), "mcd")


def distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the group's Cholesky factor."""
    ys: list[Column] = []
    for i, x in enumerate(XS):
        y = F.col(x) - F.col(f"m_{x}")
        for t in range(i):
            y = y - F.col(f"l_{i}_{t}") * ys[t]
        ys.append(y / F.col(f"l_{i}_{i}"))
    total = ys[0] * ys[0]
    for y in ys[1:]:
        total = total + y * y
    return total


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with its base statistics, ``base_failed`` and ``kept``.

    ``kept`` is false if a base rule fails or the squared Mahalanobis distance from the estimate of the
    row's language and source exceeds the chi-square quantile for ODDS. Null languages and sources are groups of
    their own. Repeated rows are judged each; an empty table gives none. An input column named like a result is replaced.
    """
    made_names = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made_names]
    # names of its own inside, so that no column of the input meets a working one
    own = {c: f"_k{i}" for i, c in enumerate(keep)}
    src = docs.select(*(docs[c].alias(k) for c, k in own.items()), docs[lang].alias("_k_lang"), docs[source].alias("_k_source"), docs[text].alias("_k_text"))
    stats = base_statistics(src, "_k_text").drop("_k_text")
    made = table(transformed(stats, "_k_lang", "_k_source"), "quality")
    by = table(_drawn_together(made), "models")
    judged = made.join(by, ["_g_lang", "_g_source"], "left").withColumn("distance", distance())
    return judged.select(
        *(F.col(k).alias(c) for c, k in own.items()), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("distance") > _limit(), F.lit(False))).alias("kept"), "distance",
    )


def _drawn_together(made: DataFrame) -> DataFrame:
    """``(_g_lang, _g_source, m_*, l_i_j)``: the estimate of each source, drawn to its language's and the whole table's."""
    rows = made.where("NOT base_failed").select("_g_lang", "_g_source", *XS, "x_lines").distinct()
    none = F.lit(None).cast("string")
    levels = [(F.col("_g_lang"), F.col("_g_source")), (F.col("_g_lang"), none), (none, none)]
    rows = rows.withColumn("g", F.explode(F.array(*(F.struct(a.alias("_g_lang"), b.alias("_g_source")) for a, b in levels))))
    rows = table(rows.select("g", *XS, "x_lines"), "vectors")
    found = estimates(rows).select("g._g_lang", "g._g_source", *(c for c in ("size", "m_x_lines", *(f"m_{x}" for x in XS), *(f"s_{i}_{j}" for i, j in PAIRS))))
    values = ["m_x_lines", *(f"m_{x}" for x in XS), *(f"s_{i}_{j}" for i, j in PAIRS)]
    top = found.where("_g_lang IS NULL").first()  # one row

    def drawn(df: DataFrame, to) -> DataFrame:
        share = F.col("size") / (F.col("size") + PRIOR_ROWS)
        return df.select("_g_lang", "_g_source", "size", *((share * F.col(c) + (1 - share) * to(c)).alias(c) for c in values))

    if top is None:
        return _factored(found.drop("size"))
    langs = drawn(found.where("_g_lang IS NOT NULL AND _g_source IS NULL"), lambda c: F.lit(top[c]))
    langs = langs.select("_g_lang", *(F.col(c).alias(f"t_{c}") for c in values))
    sources = drawn(found.where("_g_source IS NOT NULL").join(langs, "_g_lang"), lambda c: F.col(f"t_{c}"))
    return _factored(sources).select("_g_lang", "_g_source", *(f"m_{x}" for x in XS), *(f"l_{i}_{j}" for i, j in PAIRS))
