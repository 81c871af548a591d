"""Main text of web pages by composite text density.

A page is read into a tree (open elements close as browsers close them). Scripts, navigation and the like hold no text. Each other node
gets the number of characters a tag below it, adjusted for the share of linked characters and tags in it and in the page; a node's sum
is that of its children's densities. An element whose class, id or role names boilerplate, a form and a page's header are only suspects:
they count for less, and so does what lies in them. The subtree of the greatest sum, or the article that holds most text so counted, is
where the content lies, and no suspect around it is one; all others lose their text, and the sums are made again. The subtree of the
greatest sum is the content, widened to the article around it; the least density on its path from the body is the threshold for
blocks that are mostly links.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag whose quoted values may hold a >, within LONGEST characters; else a tag ends at the first one.
QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*'*)*+)>""")
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
DECLARED = re.compile(r"<[!?][^>]*+>")
TEXT = re.compile(r"[^<]++|<")
LONGEST = 2048
#: What hides all up to its end, or up to the page's.
HIDDEN = {"<!--": "-->", "<![CDATA[": "]]>"}
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math xmp noembed noframes".split())
#: Elements whose text is never content.
DROPPED = RAW | frozenset("head nav footer aside button select option datalist object canvas audio video dialog menu".split())
#: Words of a class, id or role that name boilerplate.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb
    breadcrumbs footer cookie cookies consent notice notices popup modal newsletter subscribe share sharing social comment comments disqus reply replies
    related recommended recommendations pagination pager widget toolbar login signup complementary contentinfo""".split()
)
#: Words that may stand beside them in such a name; any other word makes it a name of something else.
BESIDE = frozenset(
    """area bar block body bottom box button buttons center column content footer form global group header holder icons inner item items left link links list
    local main outer page panel post posts primary right row secondary section site slot small super top unit user wrap wrapper""".split()
)
#: What the text of a suspect counts, for each suspect that it lies in.
DOUBT = 0.25
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
    hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
#: What an opening element closes, and what that search does not go beyond.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th table caption button object".split())


HIDE = re.compile(r"(?:^|\s)(?:hidden\b|aria-hidden\s*=\s*[\"']?true)", re.I)


def _suspect(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element may be boilerplate, by what it is or by one whole name that it has."""
    if name in ("html", "body", "article", "main"):
        return False
    if name == "form" or name == "header" and not in_article:
        return True
    if not attributes or name == "header":
        return False
    for m in NAMES.finditer(attributes):
        for own in m[1].strip("\"'").split():
            words = {x.lower() for x in NAME.findall(own)}
            if words & MARKS and words <= MARKS | BESIDE:
                return True
    return False


class Page:
    """The tree in arrays, nodes in page order: element, parent, whether it is dropped, and whether it is a suspect; texts: (node,
    text), or (node, None) where a block starts or ends."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.dropped, self.suspect = ["#page"], [-1], [False], [False]
        self.texts: list[tuple[int, str | None]] = []
        stack = [0]
        opened: dict[str, list[int]] = {}  # places in the stack of each open element, so that none is searched for
        endless: set[str] = set()  # raw elements that nothing further down closes
        at, n = 0, len(source)

        def pop_to(k: int) -> None:
            for node in reversed(stack[k:]):
                opened[self.tag[node]].pop()
                if self.tag[node] in BLOCKS:
                    self.texts.append((self.parent[node], None))
            del stack[k:]

        def last(names: frozenset[str]) -> int:
            return max((own[-1] for x in names if (own := opened.get(x))), default=0)

        def find(names: frozenset[str], limits: frozenset[str]) -> int:
            k = last(names)
            return k if k >= last(limits) else 0

        end = source.rfind(">") + 1  # no tag ends further on
        while at < n:
            if source[at] != "<":
                m = TEXT.match(source, at)
                self.texts.append((stack[-1], m[0]))
                at = m.end()
                continue
            if mark := next((x for x in HIDDEN if source.startswith(x, at)), None):
                close = source.find(HIDDEN[mark], at + len(mark), end)
                if close < 0:  # so does any other
                    break
                at = close + len(HIDDEN[mark])
                continue
            if m := DECLARED.match(source, at, end):
                at = m.end()
                continue
            m = QUOTED.match(source, at, min(end, at + LONGEST)) or PLAIN.match(source, at, end)
            if m is None:
                self.texts.append((stack[-1], "<"))
                at += 1
                continue
            at = m.end()
            name = m[2].lower()
            if m[1]:
                if name == "br":
                    self.texts.append((stack[-1], " "))
                elif k := find(frozenset([name]), frozenset() if name in BLOCKS else CELLS):
                    pop_to(k)
                continue
            attributes = m[3]
            if name in BLOCKS and (k := find(frozenset(["p"]), CELLS)):
                pop_to(k)
            if name in HEADINGS and self.tag[stack[-1]] in HEADINGS:
                pop_to(len(stack) - 1)
            if name in CLOSES and (k := find(*CLOSES[name])):
                pop_to(k)
            if name == "br":
                self.texts.append((stack[-1], " "))
            if name in VOID:
                if name == "hr":
                    self.texts.append((stack[-1], None))
                continue
            if name in BLOCKS:
                self.texts.append((stack[-1], None))
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.dropped.append(self.dropped[stack[-1]] or name in DROPPED or bool(attributes and HIDE.search(attributes)))
            self.suspect.append(_suspect(name, attributes, bool(opened.get("article") or opened.get("main"))))
            if name in RAW:
                close = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at, end)
                if close is None:
                    endless.add(name)
                at = close.end() if close else n if name in ("script", "style") else at
                continue
            if not attributes.endswith("/") or name in BLOCKS:
                opened.setdefault(name, []).append(len(stack))
                stack.append(node)

    def densities(self) -> tuple[list[float], list[float], list[int], list[int]]:
        """Of each node: its density, the sum of its children's, and the characters and linked characters below it, suspects' counting
        for less."""
        n = len(self.tag)
        chars, tags, linked, links = [0.0] * n, [0] * n, [0.0] * n, [0] * n
        worth = [1.0] * n
        for i in range(1, n):
            worth[i] = worth[self.parent[i]] * (DOUBT if self.suspect[i] else 1.0)
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for node, text in self.texts:
            if text and not self.dropped[node]:
                size = len(text.strip()) * worth[node]
                chars[node] += size
                if in_link[node]:
                    linked[node] += size
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = self.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            if not self.dropped[i]:
                tags[p] += tags[i] + 1
                links[p] += links[i] + (self.tag[i] == "a")
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        share = linked[body] / chars[body] if chars[body] else 0.0
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, t, lc, lt = chars[i], max(tags[i], 1), linked[i], max(links[i], 1)
            if c:
                if share:
                    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
                    density[i] = c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / math.log(base)
                else:
                    density[i] = c / t
            if i:
                total[self.parent[i]] += density[i]
        return density, total, chars, linked

    def acquit(self) -> None:
        """Drops the suspects, but for those around the content."""
        if any(self.suspect):
            _, total, chars, _ = self.densities()
            articles = [i for i, x in enumerate(self.tag) if x in ("article", "main") and chars[i]]
            best = max(articles, key=lambda i: chars[i]) if articles else _greatest(total, chars)
            for i in self.path(best):
                self.suspect[i] = False
            for i in range(1, len(self.tag)):
                self.dropped[i] = self.dropped[i] or self.suspect[i] or self.dropped[self.parent[i]]
            self.suspect = [False] * len(self.tag)

    def path(self, node: int) -> list[int]:
        """A node and those around it, up to the body."""
        out = [node]
        while out[-1] and self.tag[out[-1]] != "body":
            out.append(self.parent[out[-1]])
        return out

    def content(self) -> list[str]:
        """The blocks of the main text."""
        n = len(self.tag)
        self.acquit()
        density, total, chars, linked = self.densities()
        if not chars[0]:
            return []
        best = _greatest(total, chars)
        path = self.path(best)
        threshold = min(density[i] for i in path)
        wide = [i for i in path if self.tag[i] in ("article", "main")]
        if wide:
            best = wide[-1]
        else:
            least = [math.inf] * n  # density of a node's blocks with text
            for i in range(1, n):
                if chars[i] and self.tag[i] in BLOCKS:
                    least[self.parent[i]] = min(least[self.parent[i]], density[i])
            while self.tag[best] not in ("body", "html", "#page") and least[self.parent[best]] >= threshold:
                best = self.parent[best]
        inside = [False] * n
        inside[best] = True
        for i in range(best + 1, n):
            mostly_links = self.tag[i] in BLOCKS and 2 * linked[i] > chars[i] and density[i] < threshold
            inside[i] = inside[self.parent[i]] and not self.dropped[i] and not mostly_links
        blocks, now = [], []
        for node, text in [*self.texts, (0, None)]:
            if text is None:
                if now and (block := " ".join("".join(now).split())):
                    blocks.append(block)
                now = []
            elif inside[node]:
                now.append(entities.unescape(text))
        return blocks


def _greatest(total: list[float], chars: list[float]) -> int:
    """The node of the greatest sum; the page itself if none has any."""
    best = max(range(len(total)), key=lambda i: (total[i] if chars[i] else -1.0, i == 0))
    return best if total[best] else 0


def main_text(source: str | None) -> str:
    return "\n".join(Page(source).content()) if source else ""


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages: the main text, blocks joined by newlines, and its code points.

    Null and empty pages, and those without text outside of boilerplate, give an empty text. Null ids and urls and repeated rows
    come back as they are. Other columns are ignored. An empty table gives an empty result."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_rows, "page_id long, url string, text string, n_chars long")
