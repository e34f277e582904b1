"""Main text of web pages by consensus host paths.

Each page's containers are scored by their running text (links count against them, semantic tags and names for
them; text counts for all containers around it, a little less at each level). A container stands for the article or main
around it, or the parents that have running text of their own, so headline, lead and sections stay together. A page
votes for the generalised paths (tags with their classes, digits masked) of its best containers so widened; votes are summed per host in Spark. Pages are then extracted from the container at their host's winning path,
or from their own best container where the page hasn't that path.

The text is what stands in the container without menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments: character references are decoded, white space within a block is one
space, blocks are joined by one space.

Votes are summed in each task before they are shuffled, so a host with a third of all pages is a few rows. The
winners are sent to all executors if they are at most MOST_BROADCAST hosts, and joined otherwise.

Defined results: null html is empty text; a null url votes with the host ''; repeated rows are extracted each;
a page without text gives ''; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

TOKEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|[!?/])")
#: The rest of a tag. A quote opens a value right after "=" only, and runs to the next such quote; a tag that doesn't end
#: before the page does has no match.
REST = re.compile(r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+(?!\s*+=)|=[^\s/>=]*+(?!\s*+=))*+>""")
ATTRIBUTE = re.compile(r"""([^\s/>=]+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+))""")
COMMENT_END = re.compile(r"--!?>")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Element kinds of HTML, and names that sites give to parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body article main section div td center".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opened element ends an open one of these, within the nearest of the given bounds.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ("html",))}
BOUNDS = CONTAINERS | {"table", "blockquote", "li", "form", "nav", "aside", "footer", "header"}
NOISE_TAGS = frozenset("head nav header footer aside form script style textarea title noscript iframe button select template svg canvas object menu dialog xmp noembed noframes audio video map".split())
#: What readers or others wrote: an article in it doesn't make it the page's own text, as it does for other noise.
FOREIGN_NAMES = frozenset("comment comments commentlist disqus respond reply replies related recommended recommendations".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
NOISE_NAMES = frozenset("nav navbar navigation menu header footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget newsletter subscribe subscription login signup search toolbar masthead copyright skip".split())
GOOD_NAMES = frozenset("article articlebody body content entry main post story text".split())
MOST_BROADCAST = 200_000
#: What counts of a text one container further up, and where that is the whole page.
DECAY, PAGE_DECAY = 0.9, 0.5
WHOLE = frozenset(("", "html", "body"))
SCHEMA = "page_id long, url string, text string, n_chars long"


def names_in(word: str) -> set[str]:
    """The words of a class or id; what follows in one like page-with-sidebar tells of a part, not of the element."""
    found = [n.lower() for n in NAME.findall(word)]
    return set(found[: next((i for i, n in enumerate(found) if n in ("with", "has", "no", "without")), len(found))])


class Paths:
    """The generalised paths of one page by number, as a trie: a number for each parent path and kind of element."""

    def __init__(self):
        self.numbers: dict[tuple[int, str], int] = {}
        self.up, self.kinds = [0], [""]

    def of(self, parent: int, kind: str) -> int:
        if (n := self.numbers.get((parent, kind))) is None:
            n = self.numbers[parent, kind] = len(self.up)
            self.up.append(parent)
            self.kinds.append(kind)
        return n

    def name(self, n: int) -> str:
        kinds = []
        while n:
            kinds.append(self.kinds[n])
            n = self.up[n]
        return "".join("/" + k for k in reversed(kinds))

    def find(self, name: str) -> int | None:
        n: int | None = 0
        for kind in name.split("/")[1:]:
            if (n := self.numbers.get((n, kind))) is None:
                return None
        return n


class Open:
    """The open elements, the outermost first; of each tag also its places among them, so that the nearest open one is
    known without a walk."""

    def __init__(self, tag: list[str]):
        self.tag, self.nodes, self.places = tag, [0], {"": [0]}

    def push(self, node: int) -> None:
        self.places.setdefault(self.tag[node], []).append(len(self.nodes))
        self.nodes.append(node)

    def nearest(self, *tags: str) -> int:
        return max([p[-1] for t in tags if (p := self.places.get(t))], default=0)

    def end(self, ended: tuple[str, ...], bounds) -> None:
        """Closes the nearest of ``ended`` and all in it, unless one of ``bounds`` is nearer."""
        at = self.nearest(*ended)
        if at and at > self.nearest(*bounds):
            for node in self.nodes[at:]:
                self.places[self.tag[node]].pop()
            del self.nodes[at:]


class Page:
    """The elements of one page: parent, tag, generalised path, whether it is noise; and its texts in order. Each step is
    linear in the page, however deep its elements lie."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.noise, self.good = [-1], [""], [0], [False], [0.0]
        self.paths = Paths()
        self.texts: list[tuple[int, str]] = []  # element, text as it stands; a block's edge is a space
        self._protected: set[int] = set()
        self._named: list[int] = []
        self._foreign: set[int] = set()
        self._parse(html)
        self._settle()

    def _attributes(self, text: str) -> dict[str, str]:
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(text) if "=" in text else ():
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # of equal ones the first stands
        return found

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        at = self._attributes(attributes)
        classes = at.get("class", "").split()
        kind = tag
        if classes:
            kind += "." + ".".join(sorted({re.sub(r"\d+", "#", c.lower()) for c in classes}))
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.paths.of(self.path[parent], kind.replace("/", "|")))
        node = len(self.tag) - 1
        names = set().union(*(names_in(c) for c in (*classes, at.get("id", ""))))
        own = bool(names & GOOD_NAMES) or tag in ("html", "body")
        self.noise.append(tag in NOISE_TAGS or at.get("role", "") in NOISE_ROLES or "display:none" in at.get("style", "").replace(" ", ""))
        if names & FOREIGN_NAMES and not own or at.get("itemprop", "") == "comment" or at.get("itemtype", "").endswith("/Comment"):
            self._foreign.add(node)
        elif names & NOISE_NAMES and tag not in ("html", "body", "article", "main"):
            self._named.append(node)
        self.good.append(1.5 if tag in ("article", "main") or at.get("itemprop") == "articleBody" else 1.25 if names & GOOD_NAMES else 1.0)
        if tag in ("article", "main") and node not in self._foreign:
            up = parent
            while up > 0 and up not in self._protected:
                self._protected.add(up)
                up = self.parent[up]
        return node

    def _parse(self, html: str) -> None:
        open_, at, low, pos = Open(self.tag), 0, None, 0
        nodes, add = open_.nodes, self.texts.append
        while (m := TOKEN.search(html, pos)) is not None:
            if m.start() > at:
                add((nodes[-1], html[at : m.start()]))
            tag, pos = m[2], m.end()
            if tag is None:  # a comment, or what browsers take as one
                if not m[3]:
                    end = html.find(">", pos) + 1
                elif html.startswith((">", "->"), pos):
                    end = html.index(">", pos) + 1
                else:
                    end = found.end() if (found := COMMENT_END.search(html, pos)) else 0
                pos = at = end or len(html)
                continue
            if (rest := REST.match(html, pos)) is None:  # the page ends within the tag: browsers drop it
                at = len(html)
                break
            attributes, pos = html[pos : rest.end() - 1], rest.end()
            at = pos
            tag = tag.lower()
            if m[1]:
                open_.end((tag,), ("table", "article", "body") if tag in INLINE else ())
                if tag not in INLINE:
                    add((nodes[-1], " "))
                continue
            if tag in ENDS_PARAGRAPH and open_.places.get("p"):
                open_.end(("p",), BOUNDS)
            if tag in ENDS:
                open_.end(*ENDS[tag])
            if tag not in INLINE:
                add((nodes[-1], " "))
            if tag in VOID or attributes.endswith("/") and tag not in CONTAINERS and tag not in RAW:
                continue
            node = self._open(tag, attributes, nodes[-1])
            if tag in RAW:
                low = low or html.lower()
                if len(low) != len(html):
                    end = re.compile(f"</{tag}", re.I).search(html, at)
                    at = end.start() if end else len(html)
                else:
                    end = low.find(f"</{tag}", at)
                    at = end if end >= 0 else len(html)
                close = html.find(">", at)
                pos = at = close + 1 if close >= 0 else len(html)
            else:
                open_.push(node)
        if at < len(html):
            add((nodes[-1], html[at:]))

    def _settle(self) -> None:
        for node in self._named:
            self.noise[node] = True
        for node in self._protected:
            if self.tag[node] not in ("script", "style", "template", "noscript"):
                self.noise[node] = False
        for node in self._foreign:
            self.noise[node] = True
        size = len(self.tag)
        self.container, self.link = [0] * size, [False] * size
        self.article, self.main = [0] * size, [0] * size
        for n in range(1, size):
            p = self.parent[n]
            self.noise[n] = self.noise[n] or self.noise[p]
            self.container[n] = n if self.tag[n] in CONTAINERS else self.container[p]
            self.link[n] = self.tag[n] == "a" or self.link[p]
            self.article[n] = self.article[p] or (n if self.tag[n] == "article" else 0)
            self.main[n] = self.main[p] or (n if self.tag[n] == "main" else 0)
        self.direct: dict[int, float] = defaultdict(float)
        for node, text in self.texts:
            if not self.noise[node] and (n := len(text.strip())):
                self.direct[self.container[node]] += -n if self.link[node] else n
        #: Of each container the outermost article around it, else the main; else itself or its highest parent in a row with
        #: text of its own.
        self.widened = list(range(size))
        for c in range(1, size):
            if self.container[c] != c:
                continue
            up = self.container[self.parent[c]]
            if found := self.article[c] or self.main[c]:
                self.widened[c] = found
            elif self.tag[up] not in WHOLE and self.direct.get(up, 0) > 0:
                self.widened[c] = self.widened[up]

    def scores(self) -> dict[int, float]:
        """Of the containers: running text below, less link text, DECAY of it at each level up."""
        own = [0.0] * len(self.tag)
        for c, value in self.direct.items():
            own[c] = value
        for c in range(len(own) - 1, 0, -1):
            if self.container[c] == c and own[c]:
                up = self.container[self.parent[c]]
                own[up] += own[c] * (PAGE_DECAY if self.tag[up] in WHOLE else DECAY)
        return {c: v * self.good[c] for c, v in enumerate(own) if v > 0}

    def best(self) -> int | None:
        found = self.scores()
        return min(found, key=lambda c: (-found[c], c)) if found else None

    def text(self, roots: set[int]) -> str:
        inside = [n in roots for n in range(len(self.tag))]
        for n in range(1, len(self.tag)):
            inside[n] = inside[n] or inside[self.parent[n]]
        return " ".join(unescape("".join(t for n, t in self.texts if inside[n] and not self.noise[n])).split())

    def extract(self, winner: str | None) -> str:
        path = self.paths.find(winner) if winner else None
        roots = {self.widened[n] for n in range(1, len(self.tag)) if self.path[n] == path and not self.noise[n]} if path else set()
        text = self.text(roots) if roots else ""
        if not text and (best := self.best()) is not None:
            text = self.text({self.widened[best]})
        return text


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def votes(pages: DataFrame, html_col: str = "html", url_col: str = "url", top: int = 3) -> DataFrame:
    """(host, path, votes): each page gives one vote, shared by its ``top`` containers as their scores are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], float] = defaultdict(float)

        def out() -> pa.RecordBatch:
            keys = list(total)
            return pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.float64())], names=["host", "path", "votes"])

        for batch in slices(batches):
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                found = page.scores()
                every, host = sum(found.values()), host_of(url)
                for c in sorted(found, key=lambda c: (-found[c], c))[:top]:
                    if c:
                        total[host, page.paths.name(page.path[page.widened[c]])] += round(found[c] / every, 3)
            if len(total) > 100_000:
                yield out()
                total.clear()
        if total:
            yield out()

    return pages.select(url_col, html_col).mapInArrow(run, "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 1).alias("votes"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: its id, url, main text, its length in code points, and the host's winning path."""
    spark = pages.sparkSession
    winners = votes(pages, html_col, url_col).groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("winner"))
    winners = written(winners, "host_paths")
    known = None
    if winners.count() <= MOST_BROADCAST:
        known = spark.sparkContext.broadcast({r["host"]: r["winner"] for r in winners.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = known.value if known is not None else None
        for batch in slices(batches):
            urls = batch.column(1).to_pylist()
            best = [paths.get(host_of(u)) for u in urls] if paths is not None else batch.column(3).to_pylist()
            texts = [Page(h or "").extract(w) for h, w in zip(batch.column(2).to_pylist(), best, strict=True)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(best, pa.string())], names=[id_col, url_col, "text", "n_chars", "host_path"])

    rows = pages.select(id_col, url_col, html_col)
    if known is None:
        host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
        rows = rows.withColumn("_host", host).join(winners.withColumnRenamed("host", "_host"), "_host", "left").select(id_col, url_col, html_col, "winner")
    return rows.mapInArrow(run, f"{id_col} long, {url_col} string, text string, n_chars long, host_path string")
