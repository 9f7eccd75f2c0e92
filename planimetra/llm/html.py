"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into text blocks. A linear classifier over tag, class and text features of a block gives the cost of each
label, which becomes its capacity from or to a terminal; neighbours on the page and blocks that are close in the
document tree are joined by smoothness edges. The maximum flow leaves a minimum cut, and the blocks on the content
side are the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimetra.llm.tables import small_batches

# Elements of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the start of another of the same kind ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table select menu".split())
ENDS_P = BLOCKS - {"body", "html", "head", "button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"}

# Weights of the classifier, in log-odds of content.
BOILERPLATE_TAGS = {"nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "button": -8.0, "select": -8.0, "search": -8.0, "header": -8.0}
CONTENT_TAGS = {"article": 5.0, "main": 4.0}
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu menubar topbar header masthead footer foot sidebar side aside rail ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "comment comments reply replies discussion disqus respond related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar copyright legal disclaimer".split()
)
#: Inside an article these name its own title.
PART_OF_ARTICLE = frozenset(("header", "masthead"))
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: What follows these in a name is something else that is there or not.
MODIFIERS = frozenset("with without has have no not is hide show before after".split())
CONTENT_NAMES = frozenset("article content main post entry story body text prose markdown".split())
NAME_WEIGHT, CONTENT_NAME_WEIGHT = -8.0, 1.5
#: Of a name that has other words beside the telling one (alert-the-press), unless they are STRUCTURE: the text may outweigh it.
PART_WEIGHT = -1.0
STRUCTURE = frozenset(
    "page site reader user post story news box bar block wrap wrapper container content list area section item items inner outer left right top bottom main primary secondary slot unit link links button "
    "icon icons group holder panel region zone frame row col column module component class id js is global local fixed sticky full small large mobile desktop text title label form field input".split()
)
#: Of names where nothing else on the page is content: what is left is the best there is. Forms then say nothing.
LAST_RESORT_WEIGHT = -1.0
LARGEST = 12.0
NEIGHBOUR, SAME_PARENT = 0.8, 0.6

_RAW = "script|style|title|textarea|template|noscript|iframe|svg|math|canvas|object|video|audio"
#: A tag whose quotes may hide a '>', and one that ends at the first.
_QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_RAW_TAGS = frozenset(_RAW.split("|"))
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW_TAGS}
_SENTENCE = re.compile(r"[.!?。](?:\s|$)")


class Block:
    __slots__ = ("text", "linked", "tag", "prior", "article", "parent", "above")

    def __init__(self, text, linked, tag, prior, article, parent, above):
        self.text, self.linked, self.tag, self.prior, self.article, self.parent, self.above = text, linked, tag, prior, article, parent, above


def _name_weight(parts: list[str], article: bool) -> float:
    """Of one class or id, by its parts: page-with-sidebar is no sidebar, and related-story-body says nothing."""
    parts = [p.lower() for p in parts]
    said = set(parts[: next((i for i, p in enumerate(parts) if p in MODIFIERS), len(parts))])
    boilerplate = bool(said & (BOILERPLATE_NAMES - PART_OF_ARTICLE if article else BOILERPLATE_NAMES))
    content = bool(said & CONTENT_NAMES)
    if boilerplate == content:
        return 0.0
    if content:
        return CONTENT_NAME_WEIGHT
    return NAME_WEIGHT if said <= BOILERPLATE_NAMES | STRUCTURE | CONTENT_NAMES else PART_WEIGHT


def _prior(tag: str, attributes: str, article: bool, last_resort: bool = False) -> float:
    weight = 0.0
    if tag in BOILERPLATE_TAGS and not (tag == "header" and article):
        weight += 0.0 if last_resort and tag == "form" else BOILERPLATE_TAGS[tag]
    weight += CONTENT_TAGS.get(tag, 0.0)
    if tag in ("body", "html") or "=" not in attributes and "hidden" not in attributes:
        return weight
    if "display:none" in attributes.replace(" ", "").lower():
        weight += NAME_WEIGHT
    for name, a, b, c in _NAMES.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            weight += NAME_WEIGHT
        elif name == "role":
            weight += NAME_WEIGHT if value.lower() in BOILERPLATE_ROLES else CONTENT_TAGS["main"] if value.lower() in ("main", "article") else 0
        else:
            for token in value.split():
                own = _name_weight(_PARTS.findall(token), article)
                weight += max(own, LAST_RESORT_WEIGHT) if last_resort else own
    return weight


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start and end of what is not text, with '/' or '' and the lowered name and attributes of a tag; comments and raw elements have no name.

    Each character is looked at a bounded number of times: where no '>' follows all is text, and after a quote that never ends quotes hide no '>' any more.
    """
    at, last, quoted = page.find("<"), page.rfind(">"), True
    while 0 <= at:
        end = at + 1
        following = page[at + 1 : at + 3]
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            end = close + 3 if close >= 0 else len(page)
            yield at, end, "", "", ""
        elif at > last:
            return
        elif following[:1].isascii() and following[:1].isalpha() or following[:1] == "/" and following[1:].isascii() and following[1:].isalpha():
            match = _QUOTED.match(page, at) if quoted else None
            if match is None:
                quoted = False
                match = _PLAIN.match(page, at)
            if match is None:  # a name that runs into a sign no name has
                end = page.find(">", at) + 1
                yield at, end, "", "", ""
            else:
                end, tag = match.end(), match[2].lower()
                if not match[1] and tag in _RAW_TAGS:
                    close = _RAW_ENDS[tag].search(page, end)
                    end = close.end() if close else len(page)
                    yield at, end, "", "", ""
                else:
                    yield at, end, match[1], tag, match[3]
        elif following[:1] in ("!", "?", "/"):
            end = page.find(">", at) + 1
            yield at, end, "", "", ""
        at = page.find("<", end)


def blocks(page: str, last_resort: bool = False) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    # tag, summed prior, whether only a form speaks against it, inside an article, element number
    stack: list[tuple[str, float, bool, bool, int]] = [("", 0.0, False, False, 0)]
    near, scopes, where = [0], [0], {}  # places in the stack of block elements, of scopes, and of each tag
    number = links = 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                own = stack[near[-1]]
                parent = stack[near[-2]][4] if len(near) > 1 else own[4]
                out.append(Block(whole, min(linked, len(whole)), own[0], stack[-1][1], own[3], parent, stack[near[-3]][4] if len(near) > 2 else 0))
        linked = 0

    def pop(to: int) -> None:
        nonlocal links
        for e in stack[to:]:
            links -= e[0] == "a"
            where[e[0]].pop()
        del stack[to:]
        for places in (near, scopes):
            while places[-1] >= to:
                places.pop()

    at = 0
    for start, end, closing, tag, attributes in tokens(page):
        if start > at:
            piece = html.unescape(page[at:start])
            text.append(piece)
            if links:
                linked += len(piece.strip())
        at = end
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        if tag in BLOCKS:
            flush()
        if closing:
            if where.get(tag) and (tag in BLOCKS or where[tag][-1] >= scopes[-1]):
                pop(where[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P and stack[near[-1]][0] == "p":
            pop(near[-1])
        if tag in SIBLINGS:
            place = max((where[t][-1] for t in SIBLINGS[tag] if where.get(t)), default=0)
            if place > scopes[-1]:
                pop(place)
        number += 1
        links += tag == "a"
        _, prior, form, article, _ = stack[-1]
        own = _prior(tag, attributes, article, last_resort)
        if form and tag in CONTENT_TAGS:  # a form around a whole page
            prior, form = own, False
        else:
            # the inner of two opposite signs decides, but nothing inside boilerplate is content again, except a page's main part
            form = own < 0 and tag == "form" and own >= BOILERPLATE_TAGS["form"] and prior >= 0 or form and own >= 0
            prior = min(prior, 0.0) + own if own < 0 else own if tag == "main" else prior + own if prior >= 0 else prior
        places = len(stack)
        stack.append((tag, prior, form, article or tag in CONTENT_TAGS, number))
        where.setdefault(tag, []).append(places)
        if tag in BLOCKS:
            near.append(places)
        if tag in SCOPES:
            scopes.append(places)
    if at < len(page):
        text.append(html.unescape(page[at:]))
    flush()
    return out


def log_odds(block: Block) -> float:
    """How much likelier the block is content, as the classifier sees it alone."""
    n = len(block.text)
    value = block.prior + (-1.0 if n < 25 else 0.0 if n < 80 else 1.5)
    value += -5.0 * block.linked / n
    value += 1.0 if _SENTENCE.search(block.text) else -0.5
    if block.tag in ("p", "blockquote", "pre"):
        value += 1.0
    elif len(block.tag) == 2 and block.tag[0] == "h" and block.tag[1].isdigit():
        value += 1.5
    if block.text.startswith(("©", "(c) ", "Copyright ")):
        value -= 4.0
    return max(-LARGEST, min(LARGEST, value))


def minimum_cut(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in the least minimum cut. excess: source less sink capacity of each node.

    A node whose terminal outweighs all its open edges is on that side of every minimum cut, so it is decided, and its edges
    become terminal capacity of its neighbours, until nothing more follows. What is left falls into small parts, and
    blocking flows solve each. A page of blocks that mostly speak for themselves takes time in proportion to its length.
    """
    excess = list(excess)
    links: list[list[tuple[int, float]]] = [[] for _ in excess]
    for a, b, capacity in edges:
        links[a].append((b, capacity))
        links[b].append((a, capacity))
    open_ = [sum(c for _, c in near) for near in links]
    side: list[bool | None] = [None] * len(excess)
    waiting = list(range(len(excess)))
    while waiting:
        v = waiting.pop()
        if side[v] is not None or abs(excess[v]) < open_[v] - _EPSILON or 0 < excess[v] <= open_[v] + _EPSILON:
            continue
        side[v] = excess[v] > 0
        for w, capacity in links[v]:
            if side[w] is None:
                excess[w] += capacity if side[v] else -capacity
                open_[w] -= capacity
                waiting.append(w)
    for start in range(len(excess)):
        if side[start] is None:
            part, at = [start], {start: 0}
            for v in part:
                for w, _ in links[v]:
                    if side[w] is None and w not in at:
                        at[w] = len(part)
                        part.append(w)
            inner = [(at[v], at[w], c) for v in part for w, c in links[v] if w in at and at[v] < at[w]]
            for v, content in zip(part, _blocking_flows([excess[v] for v in part], inner), strict=True):
                side[v] = content
    return [bool(x) for x in side]


_EPSILON = 1e-9


def _blocking_flows(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The least minimum cut of one part: levels from the source, then flows along them until every path is blocked."""
    n = len(excess)
    out: list[list[int]] = [[] for _ in excess]
    to, room = [], []
    for a, b, capacity in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        room += [capacity, capacity]
    while True:
        level = [-1] * n
        queue = [v for v in range(n) if excess[v] > _EPSILON]
        for v in queue:
            level[v] = 0
        roots, sinks = queue[:], False
        for v in queue:
            sinks |= excess[v] < -_EPSILON
            for e in out[v]:
                if room[e] > _EPSILON and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if not sinks:
            return [x >= 0 for x in level]
        following = [0] * n
        for root in roots:
            path: list[int] = []
            v = root
            while excess[root] > _EPSILON:
                if excess[v] < -_EPSILON:
                    flow = min(excess[root], -excess[v], *(room[e] for e in path))
                    excess[root] -= flow
                    excess[v] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, v = [], root
                elif following[v] < len(out[v]):
                    e = out[v][following[v]]
                    if room[e] > _EPSILON and level[to[e]] == level[v] + 1:
                        path.append(e)
                        v = to[e]
                    else:
                        following[v] += 1
                elif path:
                    v = to[path.pop() ^ 1]
                    following[v] += 1
                else:
                    break


def main_text(page: str) -> str:
    """The page's content; where names and forms alone leave none, what they leave when they say less."""
    return labelled(blocks(page)) or labelled(blocks(page, last_resort=True))


def labelled(found: list[Block]) -> str:
    if not found:
        return ""
    edges, last = [], {}
    for i, block in enumerate(found):
        if i:
            edges.append((i - 1, i, NEIGHBOUR if found[i - 1].above == block.above or found[i - 1].parent == block.parent else NEIGHBOUR / 4))
        if block.parent in last:
            edges.append((last[block.parent], i, SAME_PARENT))
        last[block.parent] = i
    kept = minimum_cut([log_odds(b) for b in found], edges)
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


_RESULT_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_RESULT_ARROW)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages; no shuffle.

    A null page is empty, and so is the text of a page without content. Broken markup is read as browsers would, as far
    as block boundaries go; a tag that never ends is text. Rows are judged one by one, so repeats and ids do not matter.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
