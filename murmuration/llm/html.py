"""Main text of web pages by composite text density.

A tolerant parser builds the element tree, in time proportional to the page. Every node gets its
characters per tag, adjusted by how many characters and tags belong to links and by the share of
link text in the whole body. A node's density sum adds the densities of its text-bearing children; the
node of the greatest sum holds the text. From there the way leads up towards the body while a
parent adds text or regions that reach the threshold, the least density on that path (see `Page.main`). Density alone finds the subtree, whatever elements and classes are called; what the
contract names (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments) is taken out by
element, role, class and id, so that it neither counts nor shows. A class or id counts only as a
whole: noise words, alone or with words of layout.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from murmuration.llm import shared

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
ATTRS = re.compile(r"""[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+>""")
RAW = frozenset("script style noscript template textarea title iframe xmp noframes".split())
#: Elements of other languages within a page: there a start tag that ends in /> has no content, and a start tag of HTML ends them.
FOREIGN = ("svg", "math")
INLINE = frozenset("b big code em embed font i img nobr s small span strong strike sub sup u".split())
INSIDE = ("foreignobject", "desc", "annotation-xml")  # where HTML goes on within them
HINT = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("head script style svg annotation annotation-xml".split())
OUT = frozenset("nav footer aside form button select option input textarea dialog menu label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status toolbar tablist".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup sidebar menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments commentlist disqus "
    "respond replies reply share sharing social related recommended recommendations widget widgets toolbar login skip alert paywall".split()
)
ONLY_PAGE = frozenset("header masthead topbar".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: What may stand beside a noise word in one class or id (site-footer, ad-slot-2). Any other part makes the token say something else (has-sidebar, tag-advertising, social-impact).
LAYOUT = frozenset(
    "area articles bar block bottom box btn button buttons close container desktop div entry fixed form global google gpt group icon icons inline inner item items js left "
    "link links list main mobile module outer page panel post posts primary region right secondary site slot sticky text title top unit wrap wrapper zone".split()
)
#: What a start tag closes if it is open and nothing of the second set lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, set(BLOCK)),
}
#: Elements that are text by their name, whatever their density.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 hgroup header p pre blockquote ul ol dl table figure b i em strong span a code".split())
SHARE = 0.2
#: A form with one of these inside, or with more than half of the page's paragraphs (and so many characters), is wrapped around the page.
LANDMARKS = frozenset("article main header footer nav aside".split())
WRAPPED = 400
CONTAINERS = frozenset("html body article main section div td th table blockquote aside nav footer header form ul ol dl figure li".split())


def noise_words(value: str) -> set[str]:
    """The noise words of a class or id attribute, from tokens that hold nothing but noise and layout words; what follows -- only modifies."""
    found = set()
    if not any(p in WORDS or p in ONLY_PAGE for p in re.split(r"[^a-z]+", value)):
        return found
    for token in value.split():
        parts = [p for p in re.split(r"[^a-z]+", token.split("--")[0] or token) if len(p) > 1]
        said = {p for p in parts if p in WORDS or p in ONLY_PAGE}
        if all(p in said or p in LAYOUT for p in parts):
            found |= said
    return found


def tokens(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, closing, attributes) of every tag, and of markup without a name (comments, declarations, raw elements with their content).

    Every character is looked at a fixed number of times. A script or style without an end goes on to the end of the page; of any other
    raw element without an end, or an iframe that closes itself, only the tag goes.
    """
    last, size, at = source.rfind(">"), len(source), 0
    endless: set[str] = set()  # raw elements of which no end tag follows
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = end + 3 if end >= 0 else size
            yield at, end, "", False, ""
            at = end
            continue
        if at > last:
            return
        m = TAG.match(source, at)
        if not m:
            if source[at + 1 : at + 2] in ("!", "?", "/"):
                end = source.find(">", at) + 1
                yield at, end, "", False, ""
                at = end
            else:
                at += 1
            continue
        name = m[2].lower()
        got = ATTRS.match(source, m.end())
        end = got.end() if got else source.find(">", m.end()) + 1
        if name in RAW and not m[1]:
            empty = name == "iframe" and source[end - 2] == "/"
            close = None if empty or name in endless else re.compile(rf"</{name}\s*>", re.I).search(source, end)
            if close:
                end = close.end()
            elif name in ("script", "style"):
                end = size
            elif not empty:
                endless.add(name)
            yield at, end, "", False, ""
        else:
            yield at, end, name, bool(m[1]), source[m.end() : end - 1]
        at = end


class Page:
    """The element tree as lists by node; `items` holds (node, text) in page order, and (node, None) where a block begins or ends."""

    def __init__(self, source: str, lists: bool = True):
        self.tag, self.parent, self.out = ["html"], [-1], [False]
        self.lists = lists
        self.items: list[tuple[int, str | None]] = []
        self.span: list[list[int]] = [[0, 0]]
        self._depths: dict[str, list[int]] = {"html": [0]}  # where on the stack each name is open
        self._scopes = [0]  # and where a container is
        self._open_words: Counter[str] = Counter()  # noise words of the open elements
        self._said: dict[int, set[str]] = {}
        self._read(source)
        self.span[0][1] = len(self.items)

    def _open(self, name: str, top: int, attrs: str) -> int:
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(top)
        noise = name in HIDDEN or bool(attrs) and self._hidden(attrs)
        if self.lists:
            noise = noise or name in OUT or bool(attrs) and self._noise(node, name, attrs) or name == "header" and not self._within()
        self.out.append(noise)
        self.span.append([len(self.items), -1])
        return node

    def _within(self) -> bool:
        return bool(self._depths.get("article") or self._depths.get("main"))

    def _hidden(self, attrs: str) -> bool:
        for key, *values in HINT.findall(attrs):
            key, value = key.lower(), next((v for v in values if v), "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        return False

    def _noise(self, node: int, name: str, attrs: str) -> bool:
        if name in ("html", "body", "main"):
            return False
        for key, *values in HINT.findall(attrs):
            key, value = key.lower(), next((v for v in values if v), "").lower()
            if key == "role" and value in ROLES and (value != "banner" or not self._within()):
                return True
            if key in ("class", "id"):
                said = noise_words(value)
                if said:
                    self._said.setdefault(node, set()).update(said)
                if (said & WORDS or said & ONLY_PAGE and not self._within()) and (name != "article" or self._minor(said)):
                    return True
        return False

    def _minor(self, said: set[str]) -> bool:
        """Whether an article of these noise words lies in another article, among comments or in an element of the same noise."""
        return bool(self._depths.get("article")) or any(self._open_words[w] for w in COMMENTS | said)

    def _nearest(self, names) -> int:
        """How deep on the stack the innermost open element of these names is; -1 if none."""
        return max((d[-1] for n in names if (d := self._depths.get(n))), default=-1)

    def _read(self, source: str) -> None:
        stack, at, tag = [0], 0, self.tag

        def pop(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                name = tag[node]
                self._depths[name].pop()
                if self._scopes[-1] == len(stack):
                    self._scopes.pop()
                for w in self._said.get(node, ()):
                    self._open_words[w] -= 1
                if name in BLOCK:
                    self.items.append((node, None))
                self.span[node][1] = len(self.items)

        for begin, end, name, closing, attrs in tokens(source):
            if begin > at:
                self.items.append((stack[-1], source[at:begin]))
            at = end
            if not name:
                continue
            if closing:
                depth = self._nearest((name,))
                if depth > 0 and (name in CONTAINERS or depth > self._scopes[-1]):
                    pop(depth)
                continue
            if name in ("html", "body") and self._depths.get(name):
                continue
            foreign = self._nearest(FOREIGN)
            if foreign > 0:
                if (name in BLOCK or name in INLINE) and self._nearest(INSIDE) < foreign:
                    pop(foreign)
                elif attrs.endswith("/"):
                    continue
            elif name in FOREIGN and attrs.endswith("/"):
                continue
            if name in BLOCK:
                depth = self._nearest(("p",))
                if depth > self._scopes[-1]:
                    pop(depth)
            if name in CLOSES:
                ends, stops = CLOSES[name]
                depth = self._nearest(ends)
                if depth > max(0, self._nearest(stops - ends)):
                    pop(depth)
            if name == "body":
                pop(1)
            if name == "br":
                self.items.append((stack[-1], " "))
                continue
            if name in VOID:
                if name == "hr":
                    self.items.append((stack[-1], None))
                continue
            node = self._open(name, stack[-1], attrs)
            if name in BLOCK:
                self.items.append((node, None))
            self._depths.setdefault(name, []).append(len(stack))
            if name in CONTAINERS:
                self._scopes.append(len(stack))
            for w in self._said.get(node, ()):
                self._open_words[w] += 1
            stack.append(node)
        if at < len(source):
            self.items.append((stack[-1], source[at:]))
        pop(0)

    def drop_noise(self) -> None:
        """Marks whole subtrees; an element with an article or main element inside is no noise by its class alone, and a form around the page is none at all."""
        holds = [t in ("article", "main") for t in self.tag]
        around = [t in LANDMARKS for t in self.tag]
        prose, within = [0] * len(self.tag), [False] * len(self.tag)
        for n, parent in enumerate(self.parent):
            within[n] = self.tag[n] == "p" or n > 0 and within[parent]
        for node, text in self.items:
            if text and within[node]:
                prose[node] += len(text)
        for n in range(len(self.tag) - 1, 0, -1):
            parent = self.parent[n]
            prose[parent] += prose[n]
            if holds[n] and not self.out[n]:
                holds[parent] = True
            if around[n]:
                around[parent] = True
        for n in range(1, len(self.tag)):
            wraps = self.tag[n] == "form" and (around[n] or prose[n] > max(WRAPPED, prose[0] // 2))
            if self.out[n] and (holds[n] and self.tag[n] not in OUT and self.tag[n] != "article" or wraps):
                self.out[n] = False
            self.out[n] = self.out[n] or self.out[self.parent[n]]

    def densities(self) -> list[float]:
        """Composite density of every node: characters per tag, adjusted by how many of both belong to links."""
        n = len(self.tag)
        chars, tags, links, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for node, text in self.items:
            if text and not self.out[node]:
                size = len(text) if not text.isspace() else 0
                chars[node] += size
                if in_link[node]:
                    links[node] += size
        for i in range(n - 1, 0, -1):
            if self.out[i]:
                continue
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        share = links[0] / max(1, chars[0])
        density = [0.0] * n
        for i in range(n - 1, -1, -1):
            if self.out[i] or not chars[i]:
                continue
            c, t, lc, lt = chars[i], max(1, tags[i]), links[i], link_tags[i]
            # Link text lowers the logarithm and raises its base; without any link the base is e.
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[i] = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / max(1.0, math.log(base))
        return density

    def main(self) -> int | None:
        """The node whose text is the main text: the one of the greatest density sum, and above it what body-path thresholds let in.

        A node's sum counts the densities of what speaks for itself, its text-bearing children, so a body of
        several regions doesn't gain from all of them. The threshold is the least density on the path from
        the node of the greatest sum to the body. On the way up that path a parent is taken in if all it adds
        is headings and other text elements, or regions that reach half the threshold or have a fair share of the sum.
        """
        self.drop_noise()
        density = self.densities()
        n, tag = len(self.tag), self.tag
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            if not self.out[i] and density[i] > 0:
                kids[self.parent[i]].append(i)
        plain = [0] * n  # a node's own text
        for node, text in self.items:
            if text and not self.out[node] and not text.isspace():
                plain[node] += len(text)
        region = [t in CONTAINERS and any(tag[k] in BLOCK for k in kids[i]) for i, t in enumerate(tag)]
        sums = [0.0] * n
        for i in range(n):
            own = [density[k] for k in kids[i] if not region[k]]
            sums[i] = sum(own) + (plain[i] if tag[i] in BLOCK else 0) if own or plain[i] else 0.0
        if not any(sums):
            return None
        top = list(sums)  # the greatest sum in each subtree
        for i in range(n - 1, 0, -1):
            if not self.out[i]:
                top[self.parent[i]] = max(top[self.parent[i]], top[i])
        best = max(range(n), key=lambda i: (sums[i], -i))
        body = next((i for i, t in enumerate(tag) if t == "body"), 0)
        limit, root, node = density[best], best, best
        while node >= 0:
            limit = min(limit, density[node])
            node = self.parent[node]
        while root not in (0, body):
            up = self.parent[root]
            more = [k for k in kids[up] if k != root]
            same = all(tag[k] in TEXT or region[k] and (density[k] >= limit / 2 or top[k] >= SHARE * top[root]) for k in more)
            if not same or up in (0, body) and more:
                break
            root = up
        return root

    def text(self, node: int | None) -> str:
        if node is None:
            return ""
        blocks, open_ = [], []
        a, b = self.span[node]
        for n, text in self.items[a:b]:
            if self.out[n]:
                if text is None and open_:
                    blocks.append("".join(open_))
                    open_ = []
            elif text is None:
                blocks.append("".join(open_))
                open_ = []
            else:
                open_.append(text)
        blocks.append("".join(open_))
        lines = (" ".join((html.unescape(x) if "&" in x else x).split()) for x in blocks)
        return "\n".join(x for x in lines if x)


def main_text(source: str | None) -> str:
    """The main text of one page: null or empty gives empty; a page without markup is its own text."""
    if not source:
        return ""
    page = Page(source)
    return page.text(page.main())


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. Null or empty html gives an empty text; a repeated
    row is repeated, an empty table gives none, and extra columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shared.small_batches(iter([batch]), "html", 8 << 20):
                texts = [main_text(x) for x in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.selectExpr(f"cast(`{page_id}` as bigint) as page_id", f"`{url}` as url", f"`{markup}` as html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shared.table(spark, sf_dir, "pages"))
