"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. What a block's markup says (elements, roles, class names) and what a classifier trained
on the pages at hand says of its form (element, length, links, punctuation) give the cost of either label; the costs are
terminal capacities. Neighbours in page order and in the DOM are tied by smoothness edges, whose weights are
counted on the same pages. The minimum cut (found by maximum flow) separates content from boilerplate.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names of HTML, by what they do to text.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "canvas", "audio", "video"}
# Their content is text up to their end tag, whatever it looks like.
TEXT_ONLY = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title", "iframe")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br",
}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "aside", "nav", "form", "body", "html", "blockquote"}

# What markup says outright. Positive speaks for content.
ELEMENTS = {
    "nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0, "button": -12.0, "select": -12.0,
    "article": 4.0, "main": 4.0,
}
OUTER_HEADER = -12.0
ROLES = {"navigation": -12.0, "banner": -12.0, "contentinfo": -12.0, "complementary": -12.0, "search": -12.0, "alert": -12.0, "dialog": -12.0, "main": 4.0, "article": 4.0}
NAMES = dict.fromkeys(
    (
        "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay toast "
        "sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommend recommended recommendations comment comments reply replies disqus "
        "subscribe newsletter signup login search pagination pager tags skip copyright disclaimer announcement"
    ).split(),
    -12.0,
) | dict.fromkeys("content article post entry story main".split(), 2.0)
# Words of a name that say where or how a part stands, not what it is, and words after or before which a name tells of another part.
PLACES = set("container wrapper wrap inner outer box block list area section item items group left right top bottom links link bar text holder row col column panel body title".split())
TELLS_OF = set("with has have no not without hide hidden toggle is layout page enabled disabled open closed visible".split())
PLAIN_ELEMENTS = {"html", "body", "article", "main"}
# The classes of a block's form, with the weights that the classifier starts from and is held to where pages say little.
FORMS = {
    "any": 0.0, "p": 1.0, "h1": 1.0, "heading": 0.5, "quote": 0.5, "li": -0.3, "td": -0.2, "words<4": -0.5, "words<10": 0.5, "words<25": 1.0,
    "words>=25": 1.5, "stop": 0.5, "some links": -1.0, "half links": -2.0, "all links": -4.0, "rights": -3.0,
}
TAG_FORM = {"p": "p", "h1": "h1", "h2": "heading", "h3": "heading", "h4": "heading", "blockquote": "quote", "pre": "quote", "figcaption": "quote", "li": "li", "dd": "li", "td": "td"}
# The kinds of ties, with the weights they start from.
TIES = {"same": 1.0, "near": 0.5, "far": 0.1, "sibling": 0.5}
PRIOR_BLOCKS, MOST_TIE = 50.0, 1.5


class _Element:
    """An open element. ``said``, ``loose`` and ``named`` hold for all text whose innermost element it is."""

    __slots__ = ("tag", "said", "loose", "named", "parent", "block", "inside", "link", "marked")

    def __init__(self, tag: str, weights: tuple[float, float, bool], parent, inside: bool, link: bool):
        weight, loose, self.named = weights
        self.tag, self.parent, self.inside, self.link = tag, parent, inside, link
        self.block = parent.block if parent is not None and tag in INLINE else self
        self.said = weight + (parent.said if parent is not None else 0.0)
        # Loose names of wrappers do not outweigh what is called content inside them.
        self.loose = loose + (parent.loose if parent is not None and not self.named else 0.0)
        # Which label the elements around give: the innermost one that speaks.
        self.marked = (1 if ELEMENTS[tag] > 0 else 0) if tag in ELEMENTS else parent.marked if parent is not None else -1


def _said(value: str) -> tuple[float, float]:
    """What a class or id says: firmly, where a name is an element's own purpose, and loosely, where it is part of a compound.

    A compound counts by its last word, by half if only its first word is known; one that tells of another part (with-, has-,
    no-, -layout) says nothing against the text. Beside a positive name, compounds say nothing against it either.
    """
    firm, loose = [], []
    for token in value.split():
        words = [x.lower() for x in WORDS.findall(token) if not x.isdigit()]
        while len(words) > 1 and words[-1] in PLACES:
            words.pop()
        weights = [NAMES.get(x, 0.0) for x in words]
        if not any(weights) or TELLS_OF.intersection(words) and min(weights) < 0:
            continue
        if weights[-1] > 0 or max(weights) < 0:
            firm.append(weights[-1])
        elif weights[-1] < 0:
            loose.append(weights[-1])
        elif weights[0] < 0:
            loose.append(weights[0] / 2)
        else:
            firm.append(max(weights))
    good = max(firm, default=0.0) > 0
    if min(firm, default=0.0) < 0:
        return min(firm), 0.0
    return (max(firm), 0.0) if good else (0.0, min(loose, default=0.0))


def _weight(tag: str, attributes: str, inside: bool) -> tuple[float, float, bool]:
    """What an element says about the text below it: firmly, loosely, and whether it calls it content by name."""
    w = OUTER_HEADER if tag == "header" and not inside else ELEMENTS.get(tag, 0.0)
    loose, named = 0.0, tag in ("article", "main")
    if not attributes:
        return w, loose, named
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if tag not in PLAIN_ELEMENTS:
                firm, part = _said(value)
                w += firm
                loose += part
                named |= firm > 0
        elif name == "role":
            said = ROLES.get(value.lower(), 0.0)
            w += said
            named |= said > 0
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            w += ELEMENTS["nav"]
    return w, 0.0 if named else loose, named


def blocks(page: str) -> list[tuple[str, float, _Element]]:
    """Text blocks in page order: decoded text, the share of it inside links, the element that holds it."""
    root = _Element("", (0.0, 0.0, False), None, False, False)
    stack, out, run, linked, holder = [root], [], [], 0, root
    skip, depth, opened = None, 0, Counter()

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append((text, min(1.0, linked / len(text)), holder))
            run, linked = [], 0

    def cut(k: int) -> None:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    at = 0
    while m := TOKEN.match(page, at):
        closing, opening, attributes = m.groups()
        at = m.end()
        tag = opening.lower() if opening is not None else closing.lower() if closing is not None else None
        if opening is not None and tag in TEXT_ONLY and not attributes.endswith("/"):
            end = TEXT_ONLY[tag].search(page, at)
            at = end.start() if end else len(page)
        if skip is not None:
            if opening is not None and tag == skip and not attributes.endswith("/"):
                depth += 1
            elif closing is not None and tag == skip:
                depth -= 1
                if not depth:
                    skip = None
            continue
        if opening is not None:
            if tag in RAW:
                if not attributes.endswith("/"):
                    skip, depth = tag, 1
                continue
            if tag not in INLINE:
                flush()
                if tag not in VOID:
                    _close_implied(stack, tag, opened, cut)
            elif tag == "br":
                run.append(" ")
            if tag not in VOID:
                top = stack[-1]
                inside = top.inside or tag in ("article", "main")
                stack.append(_Element(tag, _weight(tag, attributes, top.inside), top, inside, top.link or tag == "a"))
                opened[tag] += 1
        elif closing is not None:
            if tag not in INLINE:
                flush()
            if opened[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if tag in INLINE and stack[k].tag not in INLINE:
                        break
        else:
            text = m.group()
            if text[0] == "<" and len(text) > 1:
                if text.startswith("<![CDATA["):
                    text = text[9:].removesuffix("]]>")
                else:
                    continue
            elif "&" in text:
                text = entities.unescape(text)
            if not run:
                holder = stack[-1].block
            run.append(text)
            if stack[-1].link:
                linked += len(text.strip())
    flush()
    return out


def _close_implied(stack: list[_Element], tag: str, opened: Counter, cut) -> None:
    """Close what the start of a block ends without a tag: an open paragraph, or the list item or cell before."""
    closes = CLOSES.get(tag, ())
    if opened["p"] <= 0 and not any(opened[c] > 0 for c in closes):
        return
    for k in range(len(stack) - 1, 0, -1):
        here = stack[k].tag
        if here == "p" or here in closes:
            cut(k)
            if here == "p":
                _close_implied(stack, tag, opened, cut)
            return
        if here in SCOPES:
            return


def form(text: str, linked: float, holder: _Element) -> list[str]:
    """The classes of a block's form."""
    n = text.count(" ") + 1
    found = ["any", "words<4" if n < 4 else "words<10" if n < 10 else "words<25" if n < 25 else "words>=25"]
    if holder.tag in TAG_FORM:
        found.append(TAG_FORM[holder.tag])
    if text[-1] in ".!?…":
        found.append("stop")
    if linked > 0.05:
        found.append("all links" if linked > 0.8 else "half links" if linked > 0.3 else "some links")
    if text[0] == "©" or n < 30 and "all rights reserved" in text.lower():
        found.append("rights")
    return found


def ties(holders: list[_Element]) -> list[tuple[int, int, str]]:
    """Smoothness edges: neighbours in page order by their nearness in the DOM, and blocks of one parent across others."""
    found, last = [], {}
    for i, h in enumerate(holders):
        if i:
            g = holders[i - 1]
            if g is h or g.parent is h.parent:
                near = "same"
            elif g.parent is h or h.parent is g or h.parent is not None and g.parent is not None and h.parent.parent is g.parent.parent:
                near = "near"
            else:
                near = "far"
            found.append((i - 1, i, near))
        key = id(h.parent)
        if key in last and last[key] < i - 1:
            found.append((last[key], i, "sibling"))
        last[key] = i
    return found


@dataclass(frozen=True)
class Costs:
    """Weights of the classes of a block's form and of the kinds of ties."""

    forms: dict[str, float]
    ties: dict[str, float]


PLAIN = Costs(dict(FORMS), dict(TIES))


def page_counts(page: str | None) -> Counter:
    """What a page whose elements tell content from boilerplate has to teach: how many blocks of which form stand in which, and
    how many ties of which kind join like and unlike blocks."""
    found = blocks(page or "")
    told, marks = Counter(), [h.marked for _, _, h in found]
    if 1 not in marks:
        return told
    for (text, linked, holder), y in zip(found, marks):
        told[",".join(form(text, linked, holder)), max(y, 0)] += 1
    for a, b, kind in ties([h for _, _, h in found]):
        told[kind, int(max(marks[a], 0) == max(marks[b], 0))] += 1
    return told


def fitted(told: dict[tuple[str, int], int]) -> Costs:
    """Costs from the sums of ``page_counts`` over pages: logistic regression for the forms (Newton's method, held to
    FORMS as PRIOR_BLOCKS blocks of each form would), half the log odds of like against unlike for the ties, between 0 and MOST_TIE."""
    names, start = list(FORMS), np.array(list(FORMS.values()))
    cells = [(k, y, n) for (k, y), n in sorted(told.items()) if k not in TIES]
    x = np.array([[float(f in k.split(",")) for f in names] for k, _, _ in cells]).reshape(-1, len(names))
    y, n = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    # Every form counts as PRIOR_BLOCKS blocks against what the pages say, however many there are.
    n = n * (PRIOR_BLOCKS * 4 / max(n.sum(), PRIOR_BLOCKS * 4))
    w = start.copy()
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - PRIOR_BLOCKS / 4 * (w - start)
        w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + PRIOR_BLOCKS / 4 * np.eye(len(names)), slope)
    kinds = {k: (told.get((k, 1), 0), told.get((k, 0), 0)) for k in TIES}
    weights = {k: float(np.clip(np.log((same + 1) / (unlike + 1)) / 2, 0, MOST_TIE)) if same + unlike >= PRIOR_BLOCKS else TIES[k] for k, (same, unlike) in kinds.items()}
    return Costs(dict(zip(names, map(float, w))), weights)


def terminal(text: str, linked: float, holder: _Element, costs: Costs) -> float:
    """How much dearer it is to call a block boilerplate than to call it content."""
    return holder.said + holder.loose + sum(costs.forms[f] for f in form(text, linked, holder))


def min_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: positive scores are the price of False, negative ones that of True, ties that of differing.

    A node whose score outweighs all its ties keeps its sign in every minimum cut; it is settled first and its ties
    become terminal capacity of its neighbours. Maximum flow in layers of shortest paths settles the others. On an
    exact draw the label is False.
    """
    n, score = len(scores), list(scores)
    beside: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in ties:
        beside[a][b] = beside[a].get(b, 0.0) + c
        beside[b][a] = beside[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(score[i]) > sum(beside[i].values()):
            label[i] = score[i] > 0
            for j, c in beside[i].items():
                del beside[j][i]
                score[j] += c if label[i] else -c
                queue.append(j)
            beside[i] = {}
    left = [i for i in range(n) if label[i] is None]
    room = [dict(b) for b in beside]
    while True:
        # Distances from what still has content capacity; the layers end where boilerplate capacity is reached.
        layer = {i: 0 for i in left if score[i] > 1e-9}
        line, met = deque(layer), False
        while line:
            i = line.popleft()
            met |= score[i] < -1e-9
            for j, c in room[i].items():
                if c > 1e-9 and j not in layer:
                    layer[j] = layer[i] + 1
                    line.append(j)
        if not met:
            break
        ahead = {i: [j for j in room[i] if layer.get(j) == layer[i] + 1] for i in layer}
        for source in [i for i in layer if score[i] > 1e-9]:
            path = [source]
            while path and score[source] > 1e-9:
                i = path[-1]
                if score[i] < -1e-9:
                    flow = min([score[source], -score[i], *(room[a][b] for a, b in zip(path, path[1:]))])
                    score[source] -= flow
                    score[i] += flow
                    for a, b in zip(path, path[1:]):
                        room[a][b] -= flow
                        room[b][a] = room[b].get(a, 0.0) + flow
                    path = [source]
                elif ahead[i]:
                    j = ahead[i][-1]
                    if room[i][j] > 1e-9:
                        path.append(j)
                    else:
                        ahead[i].pop()
                else:
                    path.pop()
                    if path:
                        ahead[path[-1]].pop()
    for i in left:
        label[i] = i in layer
    return [bool(x) for x in label]


def labelled(page: str | None, costs: Costs = PLAIN) -> tuple[list[str], list[bool], list[float]]:
    """The blocks of a page, their labels by the minimum cut, and their terminal scores."""
    found = blocks(page or "")
    scores = [terminal(*b, costs) for b in found]
    joined = [(a, b, costs.ties[kind]) for a, b, kind in ties([h for _, _, h in found])]
    return [text for text, _, _ in found], min_cut(scores, joined), scores


def main_text(page: str | None, costs: Costs = PLAIN) -> str:
    """Content blocks of a page, joined by line breaks; empty for a page without any."""
    texts, kept, _ = labelled(page, costs)
    return "\n".join(text for text, k in zip(texts, kept) if k)


def fit_costs(pages: DataFrame) -> Costs:
    """Costs learned from all ``pages(html, ...)`` that tell their main part by ``article`` or ``main``. The driver gets one row per
    combination of forms, a number that the table of forms bounds. Without such a page the costs are PLAIN."""

    def run(batches):
        told = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                told.update(page_counts(page))
        kinds, labels = zip(*told) if told else ((), ())
        yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(labels, pa.int32()), pa.array(list(told.values()), pa.int64())], names=["kind", "label", "n"])

    counts = pages.select("html").mapInArrow(run, "kind string, label int, n bigint").groupBy("kind", "label").agg(F.sum("n").alias("n"))
    told = {(r["kind"], r["label"]): r["n"] for r in counts.collect()}
    return fitted(told) if told else PLAIN


def page_texts(pages: DataFrame, costs: Costs | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages(page_id, url, html, ...)``, by costs learned from the same pages unless given.

    Null and empty pages have empty texts. Every row is read on its own: repeated rows get equal results, extra columns
    are ignored, an empty table gives an empty result.
    """

    costs = costs or fit_costs(pages)

    def run(batches):
        for batch in batches:
            texts = [main_text(t, costs) for t in batch.column(2).to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
