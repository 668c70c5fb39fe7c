"""Main text of HTML pages by scoring a tree of elements."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of HTML elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: An element that begins ends an open one of these kinds, if it lies inside the innermost of the given ones.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_CELLS = frozenset("td th caption table".split())
_TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
#: What is inside them neither ends nor is ended by what is outside.
_CLOSED = frozenset("audio button canvas iframe map math noscript object select svg template video".split())
#: Elements that never hold an article's text.
_NEVER = frozenset([*_CLOSED, *"head script style title textarea option label legend fieldset datalist noembed noframes".split()])
#: Elements that stand apart from the article, unless it lies in them.
_APART = frozenset("form nav aside footer dialog menu".split())
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^\"'>]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Names in class, id or role that mark what is not the article; of a name in parts the first or last may be one of them.
_HINT = re.compile(
    r"(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus|replies|respond|sidebar\w*|nav|navbar|navigation|menu|menubar|breadcrumbs?|footer|header|masthead|topbar|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|search|contentinfo|complementary|dialog|paywall)"
)
#: Names that mark it only as the whole name, and only as that or its last part.
_WHOLE_HINT = re.compile(r"(?:side|foot|reply|form)")
_LAST_HINT = re.compile(r"(?:notices?|alert)")
#: Names that mark even an article element.
_ARTICLE_HINT = re.compile(r"(?:comments?|reply|replies|related|promo\w*|ads?|advert\w*|sponsor\w*|recommend\w*)")
_LAYOUT = frozenset("with has no without hide show is".split())
_EXEMPT = frozenset(("main", "body", "html"))
_SCORED = frozenset("p pre td blockquote".split())
_PROSE = frozenset((*_SCORED, *_HEADINGS))


def _hints(name: str) -> bool:
    parts = [p for p in re.split(r"[-_]+", name) if p]
    if not parts or parts[0] in _LAYOUT:
        return False
    return bool(_HINT.fullmatch(parts[0]) or _HINT.fullmatch(parts[-1]) or _LAST_HINT.fullmatch(parts[-1]) or _WHOLE_HINT.fullmatch(name))


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether attributes hide an element, and whether its names hint that it is not the article."""
    hidden = hinted = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            hidden = True
        elif name in ("class", "id", "role"):
            hinted |= any(_ARTICLE_HINT.fullmatch(part) for part in re.split(r"[\s_-]+", value)) if tag == "article" else any(map(_hints, value.split()))
    return hidden, hinted


class _Page:
    """Elements in page order, as lists over their numbers (a parent comes before its children), and blocks of text.

    Open elements are known by their depth, and for each tag the depths at which it is open, so that no step walks the tree.
    """

    def __init__(self, page: str):
        self.tag, self.parent, self.never, self.apart, self.blocks = ["html"], [-1], [False], [False], []
        self.open, self.names = [0], ["html"]
        self.at: dict[str, list[int]] = {"html": [0]}
        self.block_depths, self.cell_depths, self.closed_depths, self.links = [0], [-1], [-1], 0
        self.text: list[str] = []
        self.link_chars = 0
        end = 0
        for m in _tokens(page):
            if m.start() > end:
                self.add(page[end : m.start()])
            end = m.end()
            if m[1]:
                self.close(m[1].lower())
            elif m[2]:
                self.begin(m[2].lower(), m[3])
        self.add(page[end:])
        self.flush()

    def add(self, raw: str) -> None:
        if not self.never[self.open[-1]]:
            self.text.append(raw)
            if self.links:
                self.link_chars += len(" ".join(html.unescape(raw).split()))

    def flush(self) -> None:
        """Ends a block. Its pieces lie in one block element, since any that begins or ends calls this first."""
        if self.text:
            joined = " ".join(html.unescape("".join(self.text)).split())
            if joined:
                self.blocks.append((self.open[self.block_depths[-1]], joined, min(self.link_chars, len(joined))))
            self.text.clear()
        self.link_chars = 0

    def depth(self, *tags: str) -> int:
        return max((d[-1] for t in tags if (d := self.at.get(t))), default=-1)

    def pop_to(self, depth: int) -> None:
        """Ends open elements until ``depth`` are left."""
        if self.block_depths[-1] >= depth:
            self.flush()
        while len(self.open) > max(1, depth):
            self.open.pop()
            name = self.names.pop()
            if name:
                self.at[name].pop()
                self.links -= name == "a"
            for depths in (self.block_depths, self.cell_depths, self.closed_depths):
                if depths[-1] == len(self.open):
                    depths.pop()

    def end_link(self) -> None:
        depth = self.depth("a")
        if depth < 0:
            return
        if depth > self.block_depths[-1]:
            self.pop_to(depth)
        else:  # a block is open in it: the link ends, the element stays
            self.at["a"].pop()
            self.names[depth] = ""
            self.links -= 1

    def close(self, tag: str) -> None:
        if tag in ("br", "p") and self.depth(tag) < 0:
            self.flush() if tag == "p" else self.add(" ")
            return
        if tag == "a":
            self.end_link()
            return
        if tag in ("html", "body"):
            self.flush()
            return
        depth = self.depth(tag)
        limit = max(self.closed_depths[-1], self.depth("table") if tag in _TABLE_PARTS else self.cell_depths[-1])
        if depth < max(1, limit) or tag not in _BLOCK and tag not in _CLOSED and depth < self.block_depths[-1]:
            return
        self.pop_to(depth)

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "html":
            return
        if self.names[-1] == "head" and tag not in _IN_HEAD:
            self.pop_to(len(self.open) - 1)
        if tag in _VOID:
            if tag == "br":
                self.add(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in _CLOSES_P and (depth := self.depth("p")) > max(self.closed_depths[-1], self.cell_depths[-1]):
            self.pop_to(depth)
        if tag in _ENDS:
            own, until = _ENDS[tag]
            # rows and cells: the outermost open one inside the table or row ends
            limit = max(self.depth(*until), self.closed_depths[-1] if tag != "option" else -1)
            inside = [d for t in own for d in self.at.get(t, ())[-1:] if d > limit]
            if inside:
                self.pop_to(min(inside))
        elif tag in _HEADINGS and self.names[-1] in _HEADINGS:
            self.pop_to(len(self.open) - 1)
        elif tag == "a":
            self.end_link()
        if tag in _BLOCK:
            self.flush()
        if attributes.rstrip().endswith("/") and tag in ("svg", "math", "path"):
            return
        hidden, hinted = _marks(tag, attributes) if attributes else (False, False)
        if tag == "header":
            hinted |= self.depth("article", "main") < 0
        hinted = (hinted or tag in _APART) and tag not in _EXEMPT
        up = self.open[-1]
        self.tag.append(tag)
        self.parent.append(up)
        # what stands apart within a line goes at once; of blocks the scores have a say
        self.never.append(self.never[up] or hidden or tag in _NEVER or hinted and tag not in _BLOCK)
        self.apart.append(hinted)
        self.at.setdefault(tag, []).append(len(self.open))
        for kind, depths in ((_BLOCK, self.block_depths), (_CELLS, self.cell_depths), (_CLOSED, self.closed_depths)):
            if tag in kind:
                depths.append(len(self.open))
        self.open.append(len(self.tag) - 1)
        self.names.append(tag)
        self.links += tag == "a"


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags and comments. What stands in a raw-text element is no markup; its end tag is the next token."""
    at = 0
    while m := _TOKEN.search(page, at):
        yield m
        at = max(m.end(), m.start() + 1)
        if m[2] and m[2].lower() in _RAW:
            end = re.compile(rf"</{re.escape(m[2])}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)


def _points(text: str) -> int:
    return 1 + text.count(",") + min(3, len(text) // 100)


def _stand_apart(p: _Page) -> list[bool]:
    """Whether each element stands apart from the article, or lies in one that does.

    An element that hints so does not, after all, if an article or main element without hints lies in it (and it is no menu, side
    note or footer), or if it is a form with half or more of the points of all text that no hint speaks against.
    """
    holds, score = [False] * len(p.tag), [0.0] * len(p.tag)
    for node, text, links in p.blocks:
        if len(text) >= 25 and links * 2 <= len(text):
            score[node] += _points(text)
    for i in range(len(p.tag) - 1, 0, -1):
        holds[i] |= p.tag[i] in ("article", "main") and not p.never[i] and not p.apart[i]
        hint = p.apart[i] and p.tag[i] != "form"
        if not hint:
            score[p.parent[i]] += score[i]
        if not hint or p.tag[i] not in ("nav", "aside", "footer", "menu"):
            holds[p.parent[i]] |= holds[i]
    out = [False] * len(p.tag)
    for i in range(1, len(p.tag)):
        own = p.apart[i]
        if own and p.tag[i] == "form":
            own = not holds[i] and 2 * score[i] < score[0] or score[i] == 0
        elif own and p.tag[i] not in ("nav", "aside", "footer", "menu", "article"):
            own = not holds[i]
        out[i] = out[p.parent[i]] or own
    return out


def extract(page: str | None) -> str:
    """The main text of one page, in time that grows with its length, however deep its elements are nested.

    Blocks of 25 characters on give points (one, one for each comma, up to three for length) to the element that holds them, half to the
    one above and a third to the next; an element's points are discounted by its share of text in links. The element
    with most points is the container, or the article (else main element) it lies in. Kept are its blocks, and those of its siblings that score
    a fifth of it or are paragraphs of running text; of an article's siblings only other articles. If the container has no first
    heading, the last one before it beside it or an ancestor is kept. Lists of links go, but not from an article. Menus, headers,
    footers, notices, forms and the like go, see ``_stand_apart``. Without any scored block, the longest article, else all
    blocks that are not mostly links are kept. A null or empty page gives an empty text.
    """
    p = _Page(page or "")
    if not p.blocks:
        return ""
    apart, n = _stand_apart(p), len(p.tag)
    blocks = [b for b in p.blocks if not apart[b[0]]]
    chars, linked, points, scored = [0] * n, [0] * n, [0.0] * n, set()
    for node, text, links in blocks:
        chars[node] += len(text)
        linked[node] += links
        if len(text) >= 25 and (p.tag[node] in _SCORED or p.tag[node] in ("html", "div", "section", "article", "main", "body", "li", "dd")):
            to = p.parent[node] if p.tag[node] in _SCORED or p.tag[node] in ("li", "dd") else node
            for share in (1, 2, 3):
                if to < 0:
                    break
                points[to] += _points(text) / share
                scored.add(to)
                to = p.parent[to]
    for i in range(n - 1, 0, -1):
        chars[p.parent[i]] += chars[i]
        linked[p.parent[i]] += linked[i]
    density = lambda i: linked[i] / chars[i] if chars[i] else 0.0
    if not scored:
        best = max((i for i in range(n) if p.tag[i] == "article" and chars[i]), key=chars.__getitem__, default=0)
        inside = _inside(p, best)
        return "\n".join(t for i, t, links in blocks if inside[i] and links * 2 <= len(t))
    final = {i: points[i] * (1 - density(i)) for i in scored}
    best = max((i for i in sorted(scored) if p.tag[i] not in ("html", "body")), key=final.get, default=min(scored))
    if final[best] <= 0:
        best = max(sorted(scored), key=final.get)
    above, up = [], best
    while up >= 0:
        above.append(up)
        up = p.parent[up]
    outer = next((i for tag in ("article", "main") for i in above if p.tag[i] == tag), best)
    explicit, best = p.tag[outer] in ("article", "main"), outer
    above = set(above[above.index(best) + 1 :])
    inside = _inside(p, best)
    # the branch of each element among the container's siblings
    branch, side = [-1] * n, p.parent[best]
    for i in range(1, n):
        branch[i] = i if p.parent[i] == side else branch[p.parent[i]]
    least = 0.2 * final.get(best, max(final.values()))
    first_text: dict[int, str] = {}
    for i, t, _ in blocks:
        first_text.setdefault(branch[i], t)

    def beside(i: int) -> bool:
        if p.tag[i] in ("html", "body") or side < 0:
            return False
        if explicit:
            return p.tag[i] == "article" and final.get(i, 0) >= least
        running = p.tag[i] == "p" and (chars[i] >= 80 and density(i) < 0.25 or not linked[i] and re.search(r"[.!?](\s|$)", first_text.get(i, "")))
        return bool(running) or final.get(i, 0) >= least

    kept = {i for i in first_text if i >= 0 and i != best and beside(i)}
    title = _title(p, blocks, inside, above)
    in_list = _lists(p)
    out = []
    for at, (node, text, links) in enumerate(blocks):
        if inside[node] or branch[node] in kept:
            menu = not (explicit and inside[node]) and links * 2 > len(text) and p.tag[node] not in _PROSE and density(in_list[node]) > 0.5
            if not menu:
                out.append(text)
        elif at == title:
            out.append(text)
    return "\n".join(out)


def _inside(p: _Page, top: int) -> list[bool]:
    out = [False] * len(p.tag)
    for i in range(top, len(p.tag)):
        out[i] = i == top or i > 0 and out[p.parent[i]]
    return out


def _lists(p: _Page) -> list[int]:
    """The innermost list that each element lies in, else itself."""
    within = [-1] * len(p.tag)
    for i in range(1, len(p.tag)):
        within[i] = i if p.tag[i] in ("ul", "ol", "dl") else within[p.parent[i]]
    return [i if w < 0 else w for i, w in enumerate(within)]


def _title(p: _Page, blocks: list, inside: list[bool], above: set[int]) -> int | None:
    """The block that heads the container from outside: the last first-level heading before it, beside it or an ancestor."""
    found = None
    for at, (node, *_) in enumerate(blocks):
        if inside[node]:
            if p.tag[node] == "h1":
                return None
            continue
        if p.tag[node] == "h1" and (p.parent[node] in above or p.tag[p.parent[node]] in ("header", "hgroup") and p.parent[p.parent[node]] in above):
            if not any(inside[b[0]] for b in blocks[:at]):
                found = at
    return found


def extract_text(df: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``df`` with the main text of the whole page in ``out_col`` (which is replaced), empty if there is none.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed in page
    order. A null page counts as empty. Every row is handled by itself, so repeated rows give equal texts, and neither size nor
    number nor depth of elements is limited; other columns stay as they are.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract(p) for p in pages], dtype="object")

    return df.withColumn(out_col, run(F.coalesce(F.col(html_col), F.lit(""))))
