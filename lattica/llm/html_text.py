"""Main text of web pages: streaming parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clusters.

The standard library's parser streams events; block elements cut the page into lines, each of which knows the container
elements around it. A line's ratio of text to tags is smoothed over its neighbours, and lines above a threshold (a share
of the standard deviation) are high. The high text of containers, summed up the tree, chooses the region: from the root on,
the child that holds nearly all high text of its parent is entered, until there is none, or headings or paragraphs stand
beside it. Of children of like weight an ``article`` or ``main`` is entered. The region is the article as a whole, short
lines included, but for containers in it without a high line whose text is mostly links.

Elements that HTML itself sets apart (navigation, headers, footers, asides, scripts) are left out. A class, id or role
that names noise (``sidebar``, ``user-comments``; not ``notice-board-story`` or ``has-sidebar``) lowers the ratio of the lines
that lie in it entirely to zero, so they are in no cluster; it does not where the element holds the page's first heading,
its ``main`` or nearly all of its text. On a paragraph, or another element of text alone, such a name rather tells what the text
is about (``<p class=related>``): unless it names an advert or a comment, it lowers the ratio by a factor (``SOFT``) and keeps
neighbours from raising it, so a long line stays and a short one (``Share this``) goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they do to the text around them.
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("aside button datalist dialog footer head header iframe input menu nav noscript object option script select style svg template textarea title canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may be the region, and those that hold lines of their own within it.
CONTAINERS = frozenset("article body center div form main section table tbody td th tr".split())
GROUPS = CONTAINERS | frozenset("blockquote dl figure ol ul".split())
WALLS = GROUPS | DROPPED
PREFERRED = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2"))
#: Elements whose start ends an open element of the same kind (end tags may be left out).
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Names of noise, words after which a class says where such a thing stands, and words before which it says that it does not.
NAMES = frozenset("ad ads adsense adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related reply replies respond share sharing sidebar sidebars social sponsor sponsored subscribe tags toc toolbar widget widgets".split())
PLACES = frozenset("area bar block bottom box container form group inner item items left links list outer panel right section slot top unit wrap wrapper".split())
NEGATIONS = frozenset("has hide is no non not with without".split())
DISCUSSION = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Names that are meant of the text itself, on whatever element.
MEANT = DISCUSSION - {"reply", "replies"} | frozenset("ad ads adsense adv advert adverts advertisement banner consent cookie cookies popup promo promoted sponsor sponsored".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())

#: Neighbours on each side that smoothing reaches, and the share of the standard deviation that is the threshold.
RADIUS, SIGMA, SHARE = 2, 1.0, 0.5
#: Shares of a container's high text: outside the child that is entered at most; of the container's own lines at most.
OUTSIDE, OWN = 0.3, 0.05
#: Factor of the ratio of a line whose paragraph has the name of noise.
SOFT = 0.5
#: An element outweighs the page if it holds this many times the text outside it, in this many lines.
OUTWEIGHS, LINES = 10, 3
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
_hidden = re.compile(r"display\s*:\s*none", re.I).search


def noise_name(token: str) -> str | None:
    """The noise that a class or id names, by its head word: the last one that does not tell a place."""
    words = [w.lower() for w in _words(token)]
    if not words or words[0] in NEGATIONS and len(words) > 1:
        return None
    while len(words) > 1 and words[-1] in PLACES:
        words.pop()
    return words[-1] if words[-1] in NAMES else None


def _hint(tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
    """What noise an element says to be, if any."""
    if tag == "form":
        return "form"
    for name, value in attrs:
        if name in ("class", "id") and value and tag not in ("html", "body", "article", "main"):
            for token in value.split():
                if found := noise_name(token):
                    return found
        elif name == "role" and value and value.strip().lower() in ROLES:
            return "role"
    return None


def _is_dropped(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in DROPPED:
        return True
    return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _hidden(value) for name, value in attrs)


class Line:
    __slots__ = ("text", "tags", "linked", "node", "hints", "heading", "soft")

    def __init__(self, text: str, tags: int, linked: int, node: int, hints: tuple[int, ...], heading: bool, soft: bool):
        self.text, self.tags, self.linked, self.node, self.hints, self.heading, self.soft = text, tags, linked, node, hints, heading, soft


class PageLines(HTMLParser):
    """Lines of a page, its tree of containers and the elements that name noise."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, bool]] = []  # tag, dropped, container, whether it names noise
        #: Where open elements of a tag stand in ``open``, and those that tags within do not reach out of.
        self.at: dict[str, list[int]] = {}
        self.walls: list[int] = [-1]
        self.lines: list[Line] = []
        #: Of each container: its element and the container around it. The first is the page.
        self.tags_of, self.parent = ["html"], [-1]
        #: Of each element that names noise: its name, whether it holds a first heading, main or article, and whether it is one of text alone.
        self.named: list[tuple[str, set[str], bool]] = []
        self.active: list[int] = []
        self.text: list[str] = []
        self.tags = self.dropped = self.links = self.linked = 0
        self.hints: tuple[int, ...] | None = None
        self.heading = False

    def _cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            node = self.open[-1][2] if self.open else 0
            hints = self.hints or ()
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), node, tuple(k for k in hints if not self.named[k][2]), self.heading, any(self.named[k][2] for k in hints)))
        if self.text or text:
            self.text, self.tags, self.linked, self.hints = [], 0, 0, None

    def _close(self, to: int, cut: bool) -> None:
        """Ends the open elements from number ``to`` on."""
        if cut:
            self._cut()
        for tag, dropped, _, named in self.open[to:]:
            self.at[tag].pop()
            if tag in WALLS:
                self.walls.pop()
            self.dropped -= dropped
            self.links -= tag == "a"
            if named:
                self.active.pop()
            if tag in HEADINGS:
                self.heading = False
        del self.open[to:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS or tag in DROPPED:
            self._cut()
        if tag in VOID:
            return
        if tag in ENDS_P or tag in CLOSES:
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            found = max((self.at[e][-1] for e in ends if self.at.get(e)), default=-1)
            if found >= max(self.walls[-1], 0):
                self._close(found, True)
        dropped, hint = _is_dropped(tag, attrs), _hint(tag, attrs)
        node = self.open[-1][2] if self.open else 0
        if tag in GROUPS:
            self.tags_of.append(tag)
            self.parent.append(node)
            node = len(self.parent) - 1
        if tag in ("h1", "main", "article") and not self.dropped:
            for k in self.active:
                self.named[k][1].add(tag)
        if hint:
            self.active.append(len(self.named))
            self.named.append((hint, set(), tag not in GROUPS and tag != "form" and hint not in MEANT and hint != "role"))
        if tag in HEADINGS:
            self.heading = True
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in WALLS:
            self.walls.append(len(self.open))
        self.open.append((tag, dropped, node, bool(hint)))
        self.dropped += dropped
        self.links += tag == "a"

    def parse_html_declaration(self, i):
        """A marked section is a comment in pages, up to the next ``>``; the standard parser fails on one without a name."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self._cut()

    def handle_endtag(self, tag):
        self.tags += 1
        found = self.at.get(tag)
        if found and (tag in WALLS or found[-1] > self.walls[-1]):  # a stray end tag does not reach out of its container
            self._close(found[-1], any(o[0] in BLOCKS or o[0] in DROPPED for o in self.open[found[-1] :]))

    def handle_data(self, data):
        if self.dropped:
            return
        self.text.append(data)
        if data.strip():
            if self.links:
                self.linked += len(data.strip())
            if self.hints is None:
                self.hints = tuple(self.active)
            else:  # only elements that hold the whole line
                self.hints = tuple(a for a, b in zip(self.hints, self.active, strict=False) if a == b)

    def close(self):
        super().close()
        self._close(0, True)


def smoothed(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian-weighted means; at the ends of the page over the neighbours there are."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius:][: len(ratios)]
    return np.convolve(ratios, kernel)[radius:][: len(ratios)] / weight


def _noisy(parser: PageLines) -> list[bool]:
    """Of each line, whether an element that names noise holds it, and is not the page's text itself."""
    inside, count, total = [0] * len(parser.named), [0] * len(parser.named), 0
    for line in parser.lines:
        total += len(line.text)
        for k in line.hints:
            inside[k] += len(line.text)
            count[k] += 1
    noise = []
    for (name, holds, _), size, n in zip(parser.named, inside, count, strict=True):
        wraps = "h1" in holds or "main" in holds or "article" in holds and name not in DISCUSSION
        noise.append(not (wraps or n >= LINES and size >= OUTWEIGHS * (total - size)))
    return [any(noise[k] for k in line.hints) for line in parser.lines]


def _region(parser: PageLines, weight: list[int], own: list[int], heads: list[int]) -> int:
    """The container that holds the article: ``weight`` has the high text in each container, ``own`` that of its own lines,
    ``heads`` the headings in it."""
    children: dict[int, list[int]] = {}
    for node in range(1, len(parser.parent)):
        if weight[node]:
            children.setdefault(parser.parent[node], []).append(node)
    at = 0
    while True:
        under = children.get(at, ())
        inner = [c for c in under if parser.tags_of[c] in CONTAINERS]
        if not inner or parser.tags_of[at] == "article" or own[at] > OWN * weight[at]:
            return at
        best = max(inner, key=lambda c: (weight[c], -c))
        if weight[at] - weight[best] > OUTSIDE * weight[at]:
            like = [c for c in inner if parser.tags_of[c] in PREFERRED and weight[c] >= (1 - OUTSIDE) * weight[best]]
            if len(like) != 1:
                return at
            best = like[0]
        elif heads[at] and not heads[best]:
            return at
        at = best


def parsed(html: str) -> PageLines:
    """A page's events taken up. A comment or tag that the page does not end is ended with it: the standard parser would read it
    as text and look for its end again from each of its characters."""
    parser = PageLines()
    parser.feed(html)
    parser.dropped += 1
    for end in ("-->", ">", '">', "'>"):
        if not parser.rawdata.startswith("<"):
            break
        if end != "-->" or parser.rawdata.startswith("<!--"):
            parser.feed(end)
    parser.dropped -= 1
    if parser.rawdata.startswith("<") and len(parser.rawdata) > 1:
        parser.rawdata = ""
    parser.close()
    return parser


def main_text(html: str) -> str:
    """Content lines of a page in order, joined by line feeds; empty where there are none."""
    parser = parsed(html)
    lines = parser.lines
    noisy = _noisy(parser) if lines else []
    if all(noisy):
        return ""
    plain = np.array([len(line.text) / max(1, line.tags) for line in lines])
    ratios = smoothed(plain) * ~np.array(noisy)
    least = max(min(SHARE * ratios.std(), ratios.max()), 1e-9)
    soft = np.array([line.soft for line in lines])
    high = np.where(soft, SOFT * np.minimum(ratios, plain), ratios) >= least
    noisy = [bad or s and not h for bad, s, h in zip(noisy, soft.tolist(), high.tolist(), strict=True)]
    if all(noisy):
        return ""
    n = len(parser.parent)
    weight, own, heads, linked, chars, links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for line, h, bad in zip(lines, high.tolist(), noisy, strict=True):
        if bad:
            continue
        chars[line.node] += len(line.text)
        linked[line.node] += line.linked
        links[line.node] += line.linked > 0
        heads[line.node] += line.heading
        own[line.node] += len(line.text) * h
        weight[line.node] += len(line.text) * h
    for node in range(n - 1, 0, -1):  # a container comes after the one around it
        for sums in (weight, heads, linked, chars, links):
            sums[parser.parent[node]] += sums[node]
    region = _region(parser, weight, own, heads)
    inside = [False] * n
    inside[region] = True
    for node in range(region + 1, n):
        menu = not weight[node] and links[node] > 1 and 2 * linked[node] > chars[node]
        inside[node] = inside[parser.parent[node]] and not menu
    return "\n".join(line.text for line, bad in zip(lines, noisy, strict=True) if not bad and inside[line.node])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of ``pages``, repeats included.

    A null or empty page, and one of noise alone, has an empty text. Other columns of ``pages``, whatever their names, are not
    read. Every attribute of a repeated name counts; of containers of equal weight the first is entered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
