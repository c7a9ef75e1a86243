"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks.  Each block has its word count and link density, those of its two neighbours, the
evidence that its container is there for other things than the article (0 none; 1 a name that can mean either, such as
``share`` or ``notice``; 2 an element made for that, such as ``nav`` or ``form``, or a plain name, such as ``comments``) and whether it
stands in an ``article`` or ``main`` element.  A decision tree, trained on the small labelled table below, keeps or drops it: a long
block with few links is text whatever stands beside it, and only short ones depend on their neighbours.  Equal splits go to the first feature
and the lowest threshold.  A name for lists of links, such as ``related`` or ``menu``, says nothing in an article where the container has hardly a link.
A class, id or form that only hints at such a container does not count where it holds most of the page's text and no
article stands outside it, nor for an article or main element inside.  A block break is any block-level tag; ``br`` is white space.

Nulls: a null html has an empty text; pages without a kept block as well.  Repeated rows are extracted again, extra columns
are ignored, an empty table gives no rows.  Unclosed tags end with their parents.  Pages of any length and broken markup are
read in one pass: a ``<`` without a ``>`` is text, and a tag whose quotes do not match ends at its first ``>``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html iframe legend li main menu nav noscript object ol option optgroup p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math noframes xmp".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog select button head search fieldset option".split())
MAIN_TAGS = frozenset(("article", "main"))
PLAIN_HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|subscribe|newsletter|footer|sidebar|comments?|disqus|respond|replies)(?:$|[\s_-])|(?:^|\s)(?:site|page)-?header",
    re.I,
)
LINK_HINTS = re.compile(r"(?:^|[\s_-])(?:nav\w*|menu|breadcrumbs?|pagination|pager|related|recommend\w*|trending|social)(?:$|[\s_-])", re.I)
HINTS = re.compile(
    r"(?:^|[\s_-])(?:banner|notice|alert|modal|overlay|signup|login|masthead|topbar|toolbar|side|widget|share|sharing|search|copyright|legal|disclaimer|skip|hidden|screen-reader)(?:$|[\s_-])",
    re.I,
)
LAYOUT = re.compile(r"(?:^|[\s_-])(?:has|with|without|no)[_-]\S*", re.I)
WRAPPER_WORDS = 50
FEW_LINKS = 0.1
LINKS = 3
ROLES = re.compile(r"navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu", re.I)
# a tag's parts are taken whole and never given back, so a failed attempt reads a bounded stretch
TAG = re.compile(r"""<(?P<close>/?)(?P<name>[A-Za-z][^\s/><]{0,63}+)(?P<attrs>(?:[^>"']{1,4096}+|"[^"]{0,4096}+"|'[^']{0,4096}+'){0,300}+)>""")
LOOSE_TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][^\s/><]{0,63}+)(?P<attrs>[^>]*+)>")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")

# Labelled blocks (fixed values): words, link density, words and density of the block before, of the block after, evidence of
# another container, in the article's element; last the label.  A star stands for each of NEIGHBOURS.
NEIGHBOURS = ("0 0.00", "1 1.00", "5 1.00", "14 0.95", "3 0.00", "12 0.20", "30 0.00", "90 0.00")
LABELLED = """
1 1.00  * * 2 0 0
8 0.30  * * 2 0 0
25 0.00 * * 2 0 0
60 0.00 * * 2 0 0
200 0.00 * * 2 0 0
1 1.00  * * 2 1 0
12 0.20 * * 2 1 0
30 0.00 * * 2 1 0
250 0.00 * * 2 1 0
1 1.00  * * 1 0 0
12 0.00 * * 1 0 0
30 0.05 * * 1 0 0
90 0.00 * * 1 0 0
2 0.00  * * 1 1 0
9 0.30  * * 1 1 0
16 0.00 * * 1 1 0
30 0.60 * * 1 1 0
28 0.00 * * 1 1 1
60 0.10 * * 1 1 1
150 0.00 * * 1 1 1
1 0.00  * * 0 1 1
4 0.25  * * 0 1 1
8 0.00  * * 0 1 1
15 0.10 * * 0 1 1
25 0.20 * * 0 1 1
70 0.10 * * 0 1 1
300 0.02 * * 0 1 1
12 0.45 30 0.00 30 0.00 0 1 1
2 1.00 30 0.00  0 0.00 0 1 0
1 1.00  1 1.00  1 1.00 0 1 0
4 1.00 45 0.00  4 1.00 0 1 0
8 1.00  8 1.00  8 1.00 0 1 0
6 0.85 60 0.00 12 0.90 0 1 0
15 0.90 15 0.95 15 1.00 0 1 0
2 1.00 30 0.00 40 0.00 0 1 1
3 1.00 60 0.00 60 0.00 0 1 1
5 1.00 90 0.00 45 0.00 0 1 1
7 1.00 45 0.00 70 0.00 0 1 1
9 0.90 30 0.00 30 0.00 0 1 1
4 1.00 12 0.20 60 0.00 0 1 1
18 0.00 * * 0 0 1
24 0.05 * * 0 0 1
45 0.10 * * 0 0 1
60 0.00 * * 0 0 1
120 0.20 * * 0 0 1
25 0.75 * * 0 0 0
60 0.80 * * 0 0 0
1 1.00  * * 0 0 0
10 0.80 * * 0 0 0
7 0.00  2 0.50 60 0.00 0 0 1
3 0.00  1 1.00 45 0.00 0 0 1
1 0.00  0 0.00 30 0.00 0 0 1
12 0.00 50 0.00 48 0.00 0 0 1
5 0.00 40 0.00 55 0.00 0 0 1
2 0.00 20 0.00  0 0.00 0 0 1
9 0.00 35 0.00  0 0.00 0 0 1
6 0.00 28 0.00  1 1.00 0 0 0
4 0.00 60 0.00  2 1.00 0 0 0
2 0.00  0 0.00  0 0.00 0 0 1
9 0.00  0 0.00  0 0.00 0 0 1
4 0.00  2 1.00  3 1.00 0 0 0
5 0.00  3 1.00  0 0.00 0 0 0
6 0.00  2 0.00  2 1.00 0 0 0
9 0.00  3 1.00  4 1.00 0 0 0
3 0.00  0 0.00  2 1.00 0 0 0
8 0.30  4 0.90  6 0.80 0 0 0
"""


def grow_tree(rows: list[list[float]], depth: int = 8) -> tuple | float:
    """A Gini decision tree: a leaf's share of label 1, or (feature, threshold, low side, high side)."""
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return ones / len(rows)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            cost = 0.0
            for side in ([r for r in rows if r[f] <= (a + b) / 2], [r for r in rows if r[f] > (a + b) / 2]):
                p = sum(r[-1] for r in side) / len(side)
                cost += len(side) * p * (1 - p)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (a + b) / 2)
    if best is None:
        return ones / len(rows)
    _, f, t = best
    return f, t, grow_tree([r for r in rows if r[f] <= t], depth - 1), grow_tree([r for r in rows if r[f] > t], depth - 1)


@cache
def trained_tree() -> tuple | float:
    table = []
    for line in LABELLED.strip().splitlines():
        rows = [line]
        while "*" in rows[0]:
            rows = [r.replace("*", n, 1) for r in rows for n in NEIGHBOURS]
        table += [[float(x) for x in r.split()] for r in rows]
    return grow_tree(table)


def _evidence(name: str, attrs: str, in_main: bool) -> tuple[bool, int]:
    """Whether an element is a container of other things for certain, and how far it hints at that (0 to 2; ``LINKS`` for a list of links)."""
    if attrs and name not in ("html", "body") and re.search(r"\shidden(?:\s|$|=)|display:\s*none", attrs, re.I) and name not in MAIN_TAGS:
        return True, 0
    if name in CHROME_TAGS and name != "form" or name == "header" and not in_main:
        return True, 0
    if not attrs or name in ("html", "body"):
        return False, 2 * (name == "form")
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    role = found.get("role", "").lower()
    sure = name not in MAIN_TAGS and (bool(ROLES.search(role)) and role != "form" or found.get("aria-hidden") == "true")
    named = LAYOUT.sub(" ", found.get("class", "")) + " " + LAYOUT.sub(" ", found.get("id", ""))
    if name == "form" or role == "form" or PLAIN_HINTS.search(named):
        return sure, 2
    return sure, LINKS if LINK_HINTS.search(named) else int(bool(HINTS.search(named)))


def tags(page: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """(text before, tag name or none, whether it closes, attributes) in one pass; what no ``>`` ends is text."""
    at = seek = 0
    last, last_cdata = page.rfind(">"), page.rfind("]]>")
    while (at_tag := page.find("<", seek)) >= 0:
        if page.startswith("<!--", at_tag):
            end = page.find("-->", at_tag + 4)
            yield page[at:at_tag], None, False, ""
            at = seek = len(page) if end < 0 else end + 3
        elif at_tag > last:
            break
        elif page.startswith("<![CDATA[", at_tag) and at_tag < last_cdata:
            end = page.find("]]>", at_tag)
            yield page[at:at_tag] + page[at_tag + 9 : end].replace("&", "&amp;"), None, False, ""
            at = seek = end + 3
        elif page[at_tag + 1 : at_tag + 2] in ("!", "?"):
            yield page[at:at_tag], None, False, ""
            at = seek = page.find(">", at_tag) + 1
        elif m := TAG.match(page, at_tag) or LOOSE_TAG.match(page, at_tag):
            name = m["name"].lower()
            yield page[at:at_tag], name, bool(m["close"]), m["attrs"]
            at = seek = m.end()
            if name in RAW and not m["close"] and not m["attrs"].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = seek = len(page) if end is None else end.start()
        else:
            seek = at_tag + 1
    yield page[at:], None, False, ""


def blocks(page: str) -> list[tuple[str, float, int, bool]]:
    """(text, link density, evidence of another container, in the article's element) of each block in page order."""
    out: list[tuple[str, float, bool, int, bool]] = []
    # name, in a sure container, number of the innermost hinted one, in the article
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]
    opened: dict[str, int] = {}
    parent, level, in_main = [0], [0], [False]
    links, text, linked = 0, [], 0

    def flush() -> None:
        nonlocal text, linked
        words = " ".join(entities.unescape("".join(text)).split())
        if words:
            out.append((words, min(1.0, linked / len(words)), *stack[-1][1:]))
        text, linked = [], 0

    def pop(depth: int) -> None:
        for entry in stack[depth:]:
            opened[entry[0]] -= 1
        del stack[depth:]

    for before, name, close, attrs in tags(page):
        if before:
            text.append(before)
            if links:
                linked += len(" ".join(entities.unescape(before).split()))
        if name is None:
            continue
        if not close and name in RAW and not attrs.endswith("/"):
            if name in BLOCK:
                flush()
            continue
        if name == "a":
            links = max(0, links + (-1 if close else 1))
        elif name == "br":
            text.append(" ")
        if name not in BLOCK and name not in ("span", "ins", "label"):
            continue
        if name in BLOCK:
            flush()
        if name in VOID or attrs.endswith("/"):
            continue
        if close:
            if opened.get(name):
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)
                if name == "span" and stack[depth][1:3] != stack[depth - 1][1:3]:
                    flush()
                pop(depth)
            if name in BLOCK:
                links = 0
        else:
            if name == stack[-1][0] and name in ("p", "li", "td", "th", "tr", "option", "dt", "dd"):
                pop(len(stack) - 1)
            _, sure, hints, main = stack[-1]
            own, hint = _evidence(name, attrs, main)
            own |= sure
            inner = hints
            if name in MAIN_TAGS:
                # a comment or teaser can be an article as well
                inner = 0 if name == "main" or not hint else hints
            elif hint:
                parent.append(hints)
                level.append(hint)
                in_main.append(main)
                inner = len(parent) - 1
            if (own, inner) != (sure, hints) and name not in BLOCK:
                flush()
            opened[name] = opened.get(name, 0) + 1
            stack.append((name, own, inner, (main or name in MAIN_TAGS or 'role="main"' in attrs) if name in BLOCK else main))
    flush()
    # words and article blocks inside each hinted container
    inside, article, linked_words = [0.0] * len(parent), [0] * len(parent), [0.0] * len(parent)
    for t, d, sure, k, main in out:
        inside[k] += 0 if sure else len(t.split()) * (1 - d)
        linked_words[k] += 0 if sure else len(t.split()) * d
        article[k] += main and not sure
    words, articles = sum(inside), sum(article)
    for k in range(len(parent) - 1, 0, -1):
        inside[parent[k]] += inside[k] if parent[k] else 0
        article[parent[k]] += article[k] if parent[k] else 0
        linked_words[parent[k]] += linked_words[k] if parent[k] else 0
    worst = [0] * len(parent)
    for k in range(1, len(parent)):
        layout = inside[k] >= WRAPPER_WORDS and 2 * inside[k] > words and article[k] == articles
        prose = level[k] == LINKS and in_main[k] and linked_words[k] <= FEW_LINKS * inside[k]
        worst[k] = max(worst[parent[k]], 0 if layout or prose else min(2, level[k]))
    return [(t, d, 2 if sure else worst[k], main) for t, d, sure, k, main in out]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    sizes = [(float(len(t.split())), d) for t, d, _, _ in found]
    kept, tree = [], trained_tree()
    for i, (text, _, other, main) in enumerate(found):
        before, after = sizes[i - 1] if i else (0.0, 0.0), sizes[i + 1] if i + 1 < len(sizes) else (0.0, 0.0)
        x = (*sizes[i], *before, *after, float(other), float(main))
        node = tree
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        if node >= 0.5:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
