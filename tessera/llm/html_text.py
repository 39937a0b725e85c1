"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; block elements end lines. Each line has its characters, the
tags met in it and its place in the tree. The ratio of text to tags is smoothed over neighbouring lines,
and lines at or above the threshold (the smaller of mean and standard deviation) form the content clusters.

Menus, footers, forms, adverts and the like are marked by element, class, id or role. A mark says nothing, and the
clusters alone decide, where it can't be meant: on an element that is never closed, on one that holds the page's
articles while none stands outside of it, and on a form with more than half of the clusters' text.
The clusters select the region: the article or main element with most of their text; without one, the smallest
element that holds all their lines, from the first of these to the last, and the headings right before them. All
lines of the region without a mark are kept, short ones too.

Defined results: null, empty or markup-only pages give an empty text; unclosed and stray tags are
tolerated; a page without any markup is one line; equal pages give equal texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._arrow import arrow_map, arrow_type, named, pick, slices, typed

#: Elements whose character data is never text of the page.
SILENT = frozenset("script style title noscript template svg math canvas object audio video iframe textarea select button datalist".split())
#: Elements that never belong to the article.
OUTSIDE = frozenset("nav footer aside form dialog menu".split())
#: Elements that end a line when they start or end.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that may stay open, and headings.
OPEN = frozenset("p li dt dd tr td th thead tbody tfoot colgroup option optgroup html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class or id, and roles, that mark what is no article text.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed)?|promos?|promotion|banners?|sidebars?|side-?bar|menus?|nav|navbar|navigation|breadcrumbs?|"
    r"footer|site-?header|page-?header|masthead|topbar|comments?|commentlist|disqus|replies|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|"
    r"share|sharing|social|related|recommended|widgets?|pagination|pager|toolbar|search|login|signup)(?:$|[\s_-])",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Standard deviation of the smoothing kernel in lines, and its reach.
SIGMA, REACH = 1.0, 3
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-REACH, REACH + 1)]
_KERNEL_SUM = sum(_KERNEL)

#: End tags that close an open element of the same group when a new one starts.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def marked(names: str) -> bool:
    """Whether a class or id names what is no article text; has-sidebar and the like say nothing."""
    return any(MARKS.search(x) for x in names.split() if not x.lower().startswith(("has-", "no-", "with-", "without-")))


class _Node(NamedTuple):
    parent: int
    tag: str
    marked: bool


class _Lines(HTMLParser):
    """Turns parser events into lines (text, tags, node) and a tree of nodes; parents come before children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [_Node(-1, "#root", False)]
        self.unclosed: set[int] = set()
        self.stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # tag, node, silent
        self.lines: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.stack[-1][1]))
                self.tags = 0
            self.parts.clear()

    def leave(self, depth: int, closed: int) -> None:
        """Ends the open elements from depth on, of which that at `closed` has its end tag."""
        for at in range(depth, len(self.stack)):
            if at != closed and self.stack[at][0] not in OPEN:
                self.unclosed.add(self.stack[at][1])
        del self.stack[depth:]

    def close(self) -> None:
        super().close()
        self.flush()
        self.leave(1, -1)

    def handle_starttag(self, tag: str, attrs) -> None:
        silent = self.stack[-1][2]
        if tag in BLOCKS and not silent:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "body":  # whatever the head left open ends here
            self.leave(next((i + 1 for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == "html"), 1), -1)
            silent = False
        for open_tag in _CLOSES.get(tag, ()):
            if self.stack[-1][0] == open_tag:
                self.stack.pop()
                break
        inside = any(t in ("article", "main") for t, _, _ in self.stack)
        out = tag in OUTSIDE or (tag == "header" and not inside)
        if not out and attrs and tag not in ("html", "body", "article", "main"):
            for name, value in attrs:
                if (name in ("class", "id") and value and marked(value)) or (name == "role" and value in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
                    out = True
        elif not out and attrs and tag == "article":  # reader comments are often articles of their own
            out = any(name in ("class", "id") and value and re.search(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])", value, re.IGNORECASE) for name, value in attrs)
        self.nodes.append(_Node(self.stack[-1][1], tag, out))
        self.stack.append((tag, len(self.nodes) - 1, silent or tag in SILENT))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS and not self.stack[-1][2]:
            self.flush()
        self.tags += 1
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == tag:
                self.leave(depth, depth)
                break

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing over neighbouring lines; lines beyond the page count as zero."""
    n, out = len(ratios), []
    for i in range(n):
        lo, hi = max(0, i - REACH), min(n, i + REACH + 1)
        out.append(sum(ratios[j] * _KERNEL[j - i + REACH] for j in range(lo, hi)) / _KERNEL_SUM)
    return out


def _up(values: list, nodes: list[_Node], join) -> list:
    """Values of nodes joined into those of their parents, from the leaves on."""
    for n in range(len(nodes) - 1, 0, -1):
        values[nodes[n].parent] = join(values[nodes[n].parent], values[n])
    return values


def content_lines(html: str) -> list[str]:
    """Lines of the main text, in page order."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines, nodes = parser.lines, parser.nodes
    if not lines:
        return []

    def clusters(of: list[int]) -> list[int]:
        """Those of the lines that are in content clusters."""
        smooth = smoothed([len(lines[i][0]) / max(1, lines[i][1]) for i in of])
        mean = sum(smooth) / len(smooth)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
        threshold = min(mean, deviation) if deviation > 0 else 0.0
        return [i for i, x in zip(of, smooth, strict=True) if x >= threshold]

    def mass(of: list[int]) -> list[int]:
        """Characters of these lines in each element."""
        own = [0] * len(nodes)
        for i in of:
            own[lines[i][2]] += len(lines[i][0])
        return _up(own, nodes, lambda x, y: x + y)

    # Marks that count; out[n]: whether n or an element around it has one.
    texts = mass(clusters(list(range(len(lines)))))
    real = [n.tag in ("article", "main") and not n.marked and texts[i] > 0 for i, n in enumerate(nodes)]
    counts = [n.marked and i not in parser.unclosed and not (n.tag == "form" and 2 * texts[i] > texts[0]) for i, n in enumerate(nodes)]

    def outside(counts: list[bool]) -> list[bool]:
        out = list(counts)
        for i in range(1, len(nodes)):
            out[i] = out[i] or out[nodes[i].parent]
        return out

    out = outside(counts)
    if any(real) and not any(r and not o for r, o in zip(real, out, strict=True)):
        holds = _up(list(real), nodes, lambda x, y: x or y)
        out = outside([c and not h for c, h in zip(counts, holds, strict=True)])
    open_lines = [i for i, (_, _, node) in enumerate(lines) if not out[node]]
    if not open_lines:
        return []
    content = clusters(open_lines)
    texts = mass(content)
    articles = [i for i, n in enumerate(nodes) if n.tag in ("article", "main") and texts[i] > 0]

    def under(region: int) -> list[int]:
        inside = [False] * len(nodes)
        inside[region] = True
        for n in range(region + 1, len(nodes)):
            inside[n] = inside[nodes[n].parent]
        return [i for i in open_lines if inside[lines[i][2]]]

    if articles:
        return [lines[i][0] for i in under(max(articles, key=lambda n: (texts[n], n)))]  # of equal ones the inner
    region = max(n for n in range(len(nodes)) if texts[n] == texts[0])
    kept = [i for i in under(region) if content[0] <= i <= content[-1]]
    before = [i for i in open_lines if i < kept[0]]
    while before and _heading(lines[before[-1]][2], nodes):
        kept.insert(0, before.pop())
    return [lines[i][0] for i in kept]


def _heading(node: int, nodes: list[_Node]) -> bool:
    while node > 0:
        if nodes[node].tag in HEADINGS:
            return True
        node = nodes[node].parent
    return False


def extract_text(html: str | None) -> str:
    return "\n".join(content_lines(html)) if html else ""


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the kept columns and text for every page; Arrow batches are cut by bytes."""
    schema = pa.schema([("page_id", arrow_type(pages, id_col)), *[(f"k{i}", arrow_type(pages, c)) for i, c in enumerate(keep)], ("text", pa.string())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                texts = [extract_text(x) for x in part.column("html").to_pylist()]
                yield named(schema, page_id=part.column("page_id"), text=texts, **{f"k{i}": part.column(f"k{i}") for i in range(len(keep))})

    ddl = ", ".join([typed(pages, id_col, "page_id"), *[typed(pages, c, f"k{i}") for i, c in enumerate(keep)], "text string"])
    out = arrow_map(pick(pages, page_id=id_col, **{f"k{i}": c for i, c in enumerate(keep)}, html=html_col), extract, ddl)
    return out.toDF(id_col, *keep, "text")
