"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import arrow_map

# How the elements of HTML behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul center caption".split()
)
#: Elements that end an open element of the second set when they start.
ENDS = {
    **dict.fromkeys(BLOCK - {"html", "body"}, frozenset({"p"})), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}),
}
#: Where the search for such an open element stops.
SCOPES = frozenset("article aside blockquote body div footer form header html main nav ol section table ul dl".split())
#: Never part of an article: by element, by role; by a name in class or id that says nothing else.
APART = frozenset(
    "nav footer aside form button select input textarea label script style noscript template iframe svg canvas object head title menu dialog".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
HINTS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement adbox banner promo promotion"
    " sponsor sponsored notice cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup login share sharing"
    " social related recommended comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs pagination pager widget"
    " toolbar copyright disclaimer toc skip".split()
)
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+>", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORDS = re.compile(r"[a-z]{2,}")
#: Words that may stand beside a hint in such a name: where it is and what kind of box.
BESIDE = frozenset(
    "site main page top bottom left right box container wrapper wrap block section area bar list links link global primary secondary inner"
    " outer panel module holder group row column col item items post posts article entry content body text the sticky fixed full".split()
)
#: Elements that are a list of links to elsewhere if four fifths of their text and three links or more are.
LINK_LISTS = frozenset("ul ol dl div section table".split())


def _apart(name: str, attributes: str, in_article: bool) -> bool:
    if name in APART or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    return found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes))


def _hinted(name: str, attributes: str, in_article: bool) -> bool:
    """Whether a name in class or id is that of a part set apart: ``site-footer`` is one, ``has-sidebar`` is not."""
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    hints = HINTS - {"header", "masthead"} if in_article else HINTS
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = set(WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
        if words and words & hints and words <= hints | BESIDE:
            return True
    return False


class Page:
    """The elements of a page as parallel lists, parents before children, and its runs of text."""

    def __init__(self, html: str):
        self.parent, self.name, self.runs = [-1], ["body"], []
        self.hinted: list[int] = []  # elements whose names say that they are set apart
        stack, block, at = [0], 0, 0
        out_of = 0  # open elements set apart
        skipped: list[str] = []  # the element set apart that is being passed over
        inner: Counter = Counter()  # elements open inside it
        articles = 0
        pos, end = 0, len(html)
        tags_end = html.rfind(">") + 1  # no tag ends behind it, and none is looked for
        while pos < end:
            m = TAG.search(html, pos, max(tags_end, pos)) if pos < tags_end else self._open_comment(html, pos)
            upto = m.start() if m else end
            if upto > at and not skipped:
                self.runs.append((stack[-1], block, html[at:upto]))
            if not m:
                break
            pos = at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            closing = bool(m[1])
            if skipped and self._ends(skipped[0], name, closing, inner, stack):
                skipped.clear()
                inner.clear()
                block += 1
            elif skipped:
                if name not in VOID and name not in RAW:
                    inner[name] += -1 if closing else 1
                if name == skipped[0] and name not in VOID:
                    out_of += -1 if closing else 1
                    if not out_of:
                        skipped.clear()
                        inner.clear()
                        block += 1
                if not closing and name in RAW:
                    pos = at = self._raw_end(html, name, pos)
                    if skipped and name == skipped[0]:
                        out_of -= 1
                        if not out_of:
                            skipped.clear()
                            inner.clear()
                continue
            if closing:
                if name in BLOCK:
                    block += 1
                if name in ("html", "body"):
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if self.name[stack[depth]] == name:
                        articles -= sum(self.name[i] == "article" for i in stack[depth:])
                        del stack[depth:]
                        break
                    if self.name[stack[depth]] in SCOPES and name not in SCOPES:
                        break
                continue
            if name == "br":
                self.runs.append((stack[-1], block, " "))
            if name in BLOCK:
                block += 1
            if name in ("html", "body"):
                continue
            if name in ENDS:
                for depth in range(len(stack) - 1, 0, -1):
                    open_name = self.name[stack[depth]]
                    if open_name in ENDS[name]:
                        del stack[depth:]
                        break
                    if open_name in SCOPES:
                        break
            if name in RAW:
                pos = at = self._raw_end(html, name, pos)
                continue
            if _apart(name, m[3] or "", articles > 0):
                if name not in VOID and not (m[3] or "").endswith("/"):
                    skipped.append(name)
                    out_of = 1
                continue
            self.parent.append(stack[-1])
            self.name.append(name)
            if _hinted(name, m[3] or "", articles > 0):
                self.hinted.append(len(self.name) - 1)
            if name not in VOID:
                stack.append(len(self.name) - 1)
                articles += name == "article"

    def _ends(self, apart: str, name: str, closing: bool, inner: Counter, stack: list[int]) -> bool:
        """Whether this tag ends an element set apart that was never closed itself."""
        if closing:
            return name != apart and inner[name] <= 0 and name in BLOCK and any(self.name[i] == name for i in stack[1:])
        return apart in ENDS.get(name, ()) and apart in ("p", "li", "dt", "dd", "td", "th", "tr") and not any(n > 0 for n in inner.values())

    @staticmethod
    def _open_comment(html: str, pos: int):
        at = html.find("<!--", pos)
        return None if at < 0 else TAG.match(html, at)

    @staticmethod
    def _raw_end(html: str, name: str, pos: int) -> int:
        m = re.compile(f"</{name}[^>]*>", re.I).search(html, pos)
        return m.end() if m else len(html)

    def drop(self) -> None:
        """Take out parts set apart by their names, and lists of links inside articles.

        Never one that holds half of the text, unless an article stands beside it.
        """
        n = len(self.name)
        linked, article = [False] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.name[i] == "a"
            article[i] = article[self.parent[i]] or self.name[i] == "article"
        plain, in_links, links = [0] * n, [0] * n, [0] * n
        for node, _, raw in self.runs:
            size = len(raw.strip())
            (in_links if linked[node] else plain)[node] += size
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            plain[up] += plain[i]
            in_links[up] += in_links[i]
            links[up] += links[i] + (self.name[i] == "a")
        # Elements stand in the order of their beginnings: each with all below it is a run of them.
        ends = list(range(1, n + 1))
        for i in range(n - 1, 0, -1):
            ends[self.parent[i]] = max(ends[self.parent[i]], ends[i])
        stories = [i for i in range(1, n) if self.name[i] in ("article", "main") and plain[i]]
        first_end, last = min((ends[i] for i in stories), default=n), max(stories, default=-1)
        gone = [False] * n
        hinted = set(self.hinted)
        for i in range(1, n):
            listed = article[i] and self.name[i] in LINK_LISTS and links[i] >= 3 and in_links[i] >= 4 * plain[i]
            beside = first_end <= i or last >= ends[i]  # a story that this element neither holds nor is part of
            gone[i] = (
                gone[self.parent[i]] or (listed and 2 * in_links[i] < plain[0] + in_links[0])
                or (i in hinted and (beside or 2 * plain[i] < max(plain[0], 1)))
            )
        if any(gone):
            self.runs = [run for run in self.runs if not gone[run[0]]]
            kept = [i for i in range(n) if not gone[i]]
            place = {old: new for new, old in enumerate(kept)}
            self.parent = [-1 if i == 0 else place[self.parent[i]] for i in kept]
            self.name = [self.name[i] for i in kept]
            self.runs = [(place[node], block, raw) for node, block, raw in self.runs]

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of every element, and the sum of its children's.

        Characters per tag, times a logarithm that falls with the share of characters and tags in links.
        """
        n = len(self.name)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.name[i] == "a"
        for node, _, raw in self.runs:
            size = len(raw) if not raw.isspace() else 0
            chars[node] += size
            link_chars[node] += size * linked[node]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (self.name[i] == "a")
        share = link_chars[0] / max(chars[0], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, t = chars[i], max(tags[i], 1)
            if c:
                lc, lt, rest = max(link_chars[i], 1), max(link_tags[i], 1), max(c - link_chars[i], 1)
                base = log(log(c / rest * link_chars[i] + share * c + e)) if link_chars[0] else 1.0
                density[i] = c / t * (log(max(c / lc * t / lt, 1.0)) / max(base, 1e-3))
            if i:
                total[self.parent[i]] += density[i]
        return density, total

    def content(self) -> set[int]:
        """The subtree with the largest sum, and what on its way to the body is as dense as that way.

        The threshold is the least density on the path from the subtree to the body. A subtree inside an
        article element stands for the whole article; elsewhere headings beside the path belong to it too.
        """
        density, total = self.densities()
        top = max(range(len(total)), key=lambda i: (total[i], density[i], -i)) if any(total) else max(
            range(len(density)), key=lambda i: (density[i], -i)
        )
        path = [top]
        while path[-1]:
            path.append(self.parent[path[-1]])
        for wanted in ("article", "main"):
            if (own := next((i for i in path if self.name[i] == wanted), None)) is not None:
                return {own}
        least = min(density[i] for i in path)
        on_path = set(path)
        return {top} | {
            i for i in range(1, len(self.name)) if i not in on_path and self.parent[i] in on_path
            and (density[i] >= least or re.fullmatch("h[1-6]", self.name[i]))
        }

    def text(self) -> str:
        self.drop()
        if not self.runs:
            return ""
        chosen = self.content()
        inside = [False] * len(self.name)
        for i in range(len(self.name)):
            inside[i] = i in chosen or (i > 0 and inside[self.parent[i]])
        # Text that stands directly on the path between chosen parts belongs to them as well.
        if 0 in chosen:
            inside[0] = True
        blocks: dict[int, list[str]] = {}
        for node, block, raw in self.runs:
            if inside[node]:
                blocks.setdefault(block, []).append(unescape(raw))
        return "\n\n".join(b for b in (" ".join("".join(parts).split()) for parts in blocks.values()) if b)


def _extract(pages: list[str | None]) -> list:
    import pyarrow as pa

    texts = [Page(html).text() if html else "" for html in pages]
    return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: the main text of its whole html, blocks joined by an empty line, and its code points.

    Null or empty html, and pages without text, give an empty text. Broken markup is read as browsers
    read it: unclosed elements end with what holds them. Repeated rows each get their row; an empty
    table gives none. Nesting of any depth is walked without recursion.
    """
    narrow = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = pages.schema[key].dataType.simpleString()
    return arrow_map(narrow, "html", ["page_id", "url"], f"page_id {kind}, url string, text string, n_chars bigint", _extract)
