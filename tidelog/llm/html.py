"""Main-text extraction from HTML by tree scoring.

A page is read into a flat tree (parents before children, so every pass is one loop and depth does
not matter). Blocks of text earn points for their length and commas, less by their link share, and
pass them up: all to the parent, half to the next, a quarter to the one after. The container with most points is the
article's core. From there up, siblings that score well enough, or are of the same kind, belong to it, up to the element that
the page itself marks as the article.

Parts that say by tag, role or class that they are something else are left out first, but such a claim
is void where the structure refutes it: what holds the marked article, or where none is marked the first heading of the first rank, or
where there is none most of the prose, is a wrapper, whatever it is called. What is left out: menus, headers and footers of the page, sidebars, notices, adverts, forms,
readers' comments, hidden elements, scripts, styles and other markup, and, outside a marked article, lists of nothing but
links before or after all prose. Nothing else is dropped or cut.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

_OPEN = re.compile(r"""<(?:!--(?s:.*?)(?:-->|\Z)|[!?/][^>]*(?:>|\Z)|[a-zA-Z](?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+(?:>|\Z))""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Ancestors that a block's points reach, each half of the one before.
LEVELS = 4
#: Shares of the core's points that a sibling needs: beside the core, and beside its ancestors.
NEAR, FAR = 0.2, 0.4
#: What an element claims to be: nothing, something that a wrapper may be called, a form, readers' comments, a part of the page's frame, never text.
NONE, CLASS, FORM, COMMENT, FRAME, NEVER = range(6)

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
GROUPED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
FRAMES = frozenset("nav aside footer dialog menu button canvas audio video map".split())
ROLES = {"navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist note": FRAME, "form": FORM}
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())

#: Words of a class or id by what they name. State words beside them ("has-sidebar", "comments-open") speak of another element.
NAMED = {
    CLASS: (
        "ad ads advert advertisement advertising sponsor sponsored promo banner "  # adverts
        "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs header masthead topbar footer "  # frame
        "sidebar aside widget related recommended trending newsletter subscribe signup login share sharing social "  # beside the text
        "cookie cookies consent gdpr notice alert modal popup overlay paywall captcha tooltip hidden"  # over the text
    ),
    COMMENT: "comment comments commentlist discussion disqus replies responses",
}
STATE = frozenset("has no with without open closed enabled disabled on off left right".split())
_CLAIMS = {w: kind for kind, words in NAMED.items() for w in words.split()}
_ROLE_CLAIMS = {r: kind for roles, kind in ROLES.items() for r in roles.split()}


class Tree:
    """Elements in page order, and the stream of texts with their elements; a text of None is a break."""

    def __init__(self, page: str):
        self.tag, self.parent, self.names, self.claim, self.block, self.marked = ["#root"], [0], [""], [NONE], [0], [0]
        #: Places in the stack: by tag, and of blocks.
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]
        self.stream: list[tuple[int, str | None]] = []
        stack, at, size = [0], 0, len(page)
        while at < size:
            m = _OPEN.search(page, at)
            if m is None:
                self._text(stack[-1], page[at:])
                break
            if m.start() > at:
                self._text(stack[-1], page[at : m.start()])
            at, mark = m.end(), m.group()
            name = _NAME.match(mark)
            if name is None or (not mark.endswith(">") and at == size):
                continue
            tag = name.group(1).lower()
            if mark[1] == "/":
                self._close(stack, tag)
            else:
                self._open(stack, tag, mark, name.end())
                if tag in RAW and not mark.endswith("/>"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else size
                    self._cut(stack, len(stack) - 1)

    def _text(self, node: int, raw: str) -> None:
        self.stream.append((node, unescape(raw) if "&" in raw else raw))

    def _top(self, tag: str) -> int:
        """The highest place of an open tag in the stack, 0 for none."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def _cut(self, stack: list[int], k: int) -> None:
        """Closes what stands from place k of the stack on."""
        for node in stack[k:]:
            self.at[self.tag[node]].pop()
        del stack[k:]
        while self.blocks[-1] >= k:
            self.blocks.pop()

    def _close(self, stack: list[int], tag: str) -> None:
        if tag not in INLINE:
            self.stream.append((stack[-1], None))
        k = self._top(tag)
        if k and (tag not in INLINE or k > self.blocks[-1]):  # an inline end does not close blocks
            self._cut(stack, k)

    def _open(self, stack: list[int], tag: str, mark: str, at: int) -> None:
        if tag not in INLINE:
            self.stream.append((stack[-1], None))
            if tag not in VOID:
                if k := (self.at.get("p") or [0])[0]:
                    self._cut(stack, k)
                elif tag in GROUPED:  # an item that was left open ends here, unless a new list stands between
                    same, scope = GROUPED[tag]
                    bar = max(map(self._top, scope.split()))
                    open_ = [k for k in map(self._top, same.split()) if k > bar]
                    if open_:
                        self._cut(stack, min(open_))
        if tag in VOID:
            return
        up = stack[-1]
        names, claim = self._hints(tag, mark, at, up) if len(mark) > at + 1 else ("", self._claims(tag, "", "", up))
        self.tag.append(tag)
        self.parent.append(up)
        self.names.append(names)
        self.claim.append(claim)
        me = len(self.tag) - 1
        self.block.append(self.block[up] if tag in INLINE else me)
        self.marked.append(me if tag in ("article", "main") else self.marked[up])
        if not (mark.endswith("/>") and tag in INLINE):
            self.at.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                self.blocks.append(len(stack))
            stack.append(me)

    def _hints(self, tag: str, mark: str, at: int, up: int) -> tuple[str, int]:
        found = {a.lower(): (b or c or d) for a, b, c, d in _ATTRIBUTE.findall(mark, at)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        return found.get("class", ""), NEVER if hidden else self._claims(tag, names, found.get("role", "").lower(), up)

    def _claims(self, tag: str, names: str, role: str, up: int) -> int:
        """What an element says that it is."""
        if tag in ("html", "body", "main"):
            return NONE
        if tag in RAW:
            return NEVER
        if tag in FRAMES:
            return FRAME
        best = FORM if tag in ("form", "fieldset") else _ROLE_CLAIMS.get(role, NONE)
        if tag == "header" and not self.marked[up]:  # the head of an article is its own
            best = max(best, CLASS)
        for name in names.split():
            words = [w.lower() for w in _TOKEN.findall(name)]
            if not any(w in STATE for w in words):
                best = max([best, *(_CLAIMS.get(w, NONE) for w in words)])
        return best


def _sums(t: Tree, out: list[bool], linked: list[bool]) -> tuple[list[int], list[int], list[int]]:
    """Characters, commas and linked characters of each block's own text."""
    n = len(t.tag)
    own, commas, links = [0] * n, [0] * n, [0] * n
    for node, text in t.stream:
        if text is not None and not out[node]:
            size = len(text.strip())
            b = t.block[node]
            own[b] += size
            commas[b] += text.count(",") + text.count("、") + text.count("，")
            if linked[node]:
                links[b] += size
    return own, commas, links


def _points(own: list[int], commas: list[int], links: list[int]) -> list[float]:
    return [(size / 100 + c / 2) * (1 - x / size) if size else 0.0 for size, c, x in zip(own, commas, links, strict=True)]


def _up(t: Tree, values: list) -> list:
    """Sums over subtrees."""
    total = values[:]
    for i in range(len(values) - 1, 0, -1):
        total[t.parent[i]] += total[i]
    return total


def _left_out(t: Tree, linked: list[bool]) -> list[bool]:
    """Elements outside the article: those whose claim stands, with all in them."""
    n = len(t.tag)
    frame = [False] * n
    for i in range(1, n):
        frame[i] = frame[t.parent[i]] or t.claim[i] >= FRAME
    prose = _up(t, _points(*_sums(t, frame, linked)))
    slight = frame[:]  # in a part that makes a claim and holds little of the prose
    for i in range(1, n):
        slight[i] = frame[i] or slight[t.parent[i]] or t.claim[i] != NONE and prose[i] <= 0.25 * prose[0]
    first = next((i for i in range(n) if t.tag[i] == "h1" and not slight[i]), None)
    leads = _up(t, [int(i == first) for i in range(n)])
    article = _up(t, [int(t.tag[i] in ("article", "main") and not frame[i] and t.claim[i] < COMMENT and prose[i] > 0) for i in range(n)])

    def void(i: int) -> bool:
        if t.claim[i] == COMMENT:  # readers may write more than the author, and each in an article
            return bool(leads[i]) and prose[i] > 0.5 * prose[0] or prose[i] >= prose[0]
        if article[0]:
            return bool(article[i]) and not commented[i]
        return bool(leads[i]) if first is not None else prose[i] > 0.5 * prose[0]

    commented = [False] * n
    for kinds in ((CLASS, FORM, COMMENT, FRAME, NEVER), (FRAME, NEVER), (NEVER,)):
        out = [False] * n
        for i in range(1, n):
            up, kind = t.parent[i], t.claim[i]
            out[i] = out[up] or (kind in kinds and (kind >= FRAME or not void(i)))
            commented[i] = commented[up] or kind == COMMENT and out[i]
        if any(text and not text.isspace() and not out[i] for i, text in t.stream):
            break  # else nothing is left: weaker claims give way
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: blocks in page order, white space inside them and between them one space."""
    if not page:
        return ""
    t = Tree(page)
    n = len(t.tag)
    linked = [False] * n
    for i in range(1, n):
        linked[i] = t.tag[i] == "a" or linked[t.parent[i]]
    out = _left_out(t, linked)
    own, commas, links = _sums(t, out, linked)
    points = _points(own, commas, links)
    total, inside, size = _up(t, points), _up(t, links), _up(t, own)
    score = [0.0] * n
    for b in range(1, n):
        if points[b] and not out[b]:
            # a paragraph's points go to its container; bare text makes its own element one
            at, share = (t.block[t.parent[b]] if t.tag[b] in TEXTUAL or t.tag[b] in ("li", "dd", "dt") else b), 1.0
            for _ in range(LEVELS):
                if not at or t.tag[at] == "html":
                    break
                score[at] += share * points[b]
                share, at = share / 2, t.block[t.parent[at]]
    chosen = _chosen(t, score, total, inside, size, out)
    take = [False] * n
    for i in range(n):
        take[i] = i in chosen or (i > 0 and take[t.parent[i]])
    _drop_menus(t, take, out, points, size, inside)
    parts: list[str] = []
    last = -1
    for node, text in t.stream:
        if text is None:
            parts.append(" ")
        elif take[node] and not out[node]:
            if t.block[node] != last:
                parts.append(" ")
                last = t.block[node]
            parts.append(text)
    return " ".join("".join(parts).split())


def _chosen(t: Tree, score: list[float], total: list[float], inside: list[int], size: list[int], out: list[bool]) -> set[int]:
    """The core and what belongs to it, beside it and beside its ancestors."""
    n = len(t.tag)
    plain = [size[i] > 0 and 2 * inside[i] <= size[i] for i in range(n)]
    core = max((i for i in range(n) if not out[i]), key=lambda i: (score[i] * (1 - inside[i] / size[i]) if size[i] else 0.0, -i), default=0)
    if not score[core]:  # no prose: what the page marks as the article, else all that is left
        named = [i for i in range(n) if t.tag[i] in ("article", "main") and not out[i] and size[i]]
        return {max(named, key=lambda i: (size[i], -i))} if named else {0}
    if t.marked[core] and plain[t.marked[core]]:
        return {t.marked[core]}
    kids: dict[int, list[int]] = {}
    for i in range(1, n):
        if not out[i] and size[i]:
            kids.setdefault(t.parent[i], []).append(i)
    chosen, at, bar = {core}, core, NEAR * total[core]
    while at and t.tag[at] not in ("body", "html"):
        up = t.parent[at]
        for i in kids.get(up, ()):
            alike = t.tag[i] == t.tag[at] and (t.tag[i] == "section" or t.names[i] == t.names[at] != "")
            text = t.tag[i] in TEXTUAL and t.tag[i] not in ("ul", "ol", "table") and at == core
            if i != at and plain[i] and (total[i] >= bar or alike or text):
                chosen.add(i)
        at, bar = up, FAR * total[core]
    return chosen


def _drop_menus(t: Tree, take: list[bool], out: list[bool], points: list[float], size: list[int], inside: list[int]) -> None:
    """Outside a marked article, lists of nothing but links that stand before or after all prose are menus."""
    prose = [i for i in range(len(t.tag)) if take[i] and points[i] >= 0.25 and not out[i]]
    if not prose:
        return
    first, last = prose[0], prose[-1]
    for i in range(1, len(t.tag)):
        menu = t.tag[i] in ("ul", "ol") and take[i] and not t.marked[i] and size[i] and inside[i] == size[i] and not first < i < last
        out[i] = out[i] or out[t.parent[i]] or bool(menu)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of every row with ``text`` and ``n_chars``, the main text of the whole page.

    Dropped are the parts that the module names, by structure first and by what they call themselves second.
    Null and empty pages, and pages without text, have an empty text. Repeated rows are extracted each;
    columns named like a result are replaced; an empty table gives no row.
    """
    keep = [c for c in (keep if keep is not None else [c for c in pages.columns if c != html]) if c.lower() not in ("text", "n_chars")]
    src = pages.select(*keep, pages[html].alias("_h_html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.select(keep).schema)
    return src.mapInArrow(run, f"{fields}text string, n_chars long")
