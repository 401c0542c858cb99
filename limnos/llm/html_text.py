"""Main text of web pages by host consensus.

1. Every page is parsed into blocks (paragraphs, headings, list items ...) that stand in containers (body, div, article ...).
   A container's score is the text of its own blocks less their links, and half of its child containers' scores.
   From the best container a page climbs to the highest article by tag or class about it, and on while a container above
   holds text of its own or, where no article is declared, parts that add a twentieth or more to the text.
2. A container's path is generalised: tags with their first class, digits as #. Each page votes for the path it climbed to;
   Spark sums the votes by host, and the path with the most wins the host.
3. Pages are parsed again; the blocks within the containers on the host's winning path are the text. A page where these
   hold no text, or less than a tenth of an article that the page declares by tag or class, falls back on its own best one; so do
   pages without a host, which have nothing in common.

Boilerplate subtrees (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments) count nowhere. Outside
an article one boilerplate word in a class or id marks a subtree; within one a whole name of such words, and words
of layout, is needed, so that a paragraph of class `share-price` stays and a `share-buttons` box goes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest

from .common import materialize, unused
from .url_filter import host as host_of

#: Hosts whose winners are broadcast at most.
BROADCAST_HOSTS = 200_000
#: Characters of a path beyond which its upper part is written as a hash, so that deep nesting stays linear.
LONG_PATH = 500
#: Share of a container's text that its parts beside the best one add, from which they belong to an undeclared article.
ADDS = 0.05

# HTML's element kinds, and the class and id words of boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea iframe svg xmp noembed noframes".split()
SKIP = frozenset("head title nav footer aside form button select dialog menu object canvas audio video map fieldset".split())
CONTAINERS = frozenset("body div article section main td center dd blockquote".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul caption".split()
)
BOILERPLATE = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar aside masthead footer comment comments commentlist disqus replies responses reviews teaser teasers share sharing social related recommended newsletter subscribe signup login popup modal overlay widget widgets toolbar pagination pager copyright search".split()
)
LAYOUT = frozenset("area article articles bar block body bottom box btn button buttons card col column container content entries entry group header heading icons inline inner item items js label left line link links list main media module outer page pages panel post posts reader readers right row section site slot stories text thread title top unit user users wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
ARTICLE_WORDS = frozenset("article post entry content story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-z][^<>]*+\Z"  # cut off within a tag
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _judged(tag: str, attrs: str, in_article: bool, by_name: bool) -> tuple[bool, bool, str]:
    """Whether an element starts a boilerplate subtree (by tag, role and, if by_name, class and id), whether it is an article by tag or class, and its first class."""
    article = tag in ("article", "main")
    if tag in SKIP or (tag == "header" and not in_article):
        return True, False, ""
    if not attrs or attrs.isspace():
        return False, article, ""
    values = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    named = [{w.lower() for w in _WORD.findall(name)} for name in f"{values.get('class', '')} {values.get('id', '')}".split()]
    words = set().union(*named)
    skip = by_name and (any(n & BOILERPLATE and (not in_article or n <= BOILERPLATE | LAYOUT) for n in named) or ("header" in words and not in_article and not words & ARTICLE_WORDS))
    skip = skip or values.get("role", "").lower() in ROLES
    hidden = values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "") or re.search(r"(?:^|\s)hidden(?:\s|/|$)", _ATTR.sub("", attrs))
    first = values.get("class", "").split()
    whole = tag in ("html", "body")
    return (skip or bool(hidden)) and not whole, article or (bool(words & ARTICLE_WORDS) and not whole), first[0] if first else ""


class Page:
    """A parsed page: containers (path, parent) and blocks (container, text, link characters) in page order. Where the names of classes and ids leave no text, the page is parsed without them."""

    def __init__(self, html: str):
        self._parse(html, True)
        if self.best() is None:
            kept = self.__dict__
            self.__dict__ = {}
            self._parse(html, False)
            if self.best() is None:
                self.__dict__ = kept

    def _parse(self, html: str, by_name: bool) -> None:
        self.paths: list[str] = ["body"]
        self.parents: list[int] = [-1]
        self.declared: list[bool] = [False]
        self.blocks: list[tuple[int, str, int]] = []
        buffer: list[str] = []
        links = 0
        stack: list[tuple[str, int, bool, bool]] = []  # tag, container, whether skipped, whether an article
        places: dict[str, list[int]] = defaultdict(list)  # of the open elements by tag
        walls: list[int] = []  # places of the open block elements
        container, skip, anchors, articles, at = 0, False, 0, 0, 0

        def flush() -> None:
            nonlocal links
            if buffer:
                if text := " ".join("".join(buffer).split()):
                    self.blocks.append((container, text, min(links, len(text))))
                buffer.clear()
            links = 0

        def pop(n: int) -> None:
            """Closes the elements above the n lowest."""
            nonlocal container, skip, anchors, articles
            for tag, _, _, article in stack[n:]:
                anchors -= tag == "a"
                articles -= article
                places[tag].pop()
            del stack[n:]
            while walls and walls[-1] >= n:
                walls.pop()
            container, skip = (stack[-1][1], stack[-1][2]) if stack else (0, False)

        for m in _TOKEN.finditer(html):
            if m.start() > at and not skip:
                text = unescape(html[at : m.start()])
                buffer.append(text)
                links += len(text) * (anchors > 0)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                if tag in BLOCKS:
                    flush()
                if (open_ := places.get(tag)) and (tag in BLOCKS or not walls or walls[-1] < open_[-1]):
                    pop(open_[-1])
                continue
            if tag in BLOCKS:
                flush()
                closed = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}.get(tag, ()) + ("p",)
                while walls and stack[walls[-1]][0] in closed:
                    pop(walls[-1])
            elif tag == "br":
                buffer.append(" ")
            if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCKS:
                continue
            boiler, article, css = _judged(tag, m["attrs"], articles > 0, by_name)
            if boiler and not skip and tag not in BLOCKS:
                buffer.append(" ")
            skip = skip or boiler
            if tag in CONTAINERS and tag != "body" and not skip:
                above = self.paths[container]
                if len(above) > LONG_PATH:
                    above = xxh64_hexdigest(above)
                name = f"{above}>{tag}" + (f".{re.sub('[0-9]+', '#', css)}" if css else "")
                self.paths.append(name)
                self.parents.append(container)
                self.declared.append(article)
                container = len(self.paths) - 1
            anchors += tag == "a"
            articles += article
            places[tag].append(len(stack))
            if tag in BLOCKS:
                walls.append(len(stack))
            stack.append((tag, container, skip, article))
        if not skip and at < len(html):
            buffer.append(unescape(html[at:]))
        flush()

    def scores(self) -> list[float]:
        out = [0.0] * len(self.paths)
        for c, text, links in self.blocks:
            out[c] += max(0, len(text) - 2 * links)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i] / 2
        return out

    def best(self) -> int | None:
        """The container of the whole article, or None where no text stands outside links."""
        scores = self.scores()
        c = max(range(len(scores)), key=lambda i: (scores[i], -i))
        if not scores[c]:
            return None
        own = {i for i, text, links in self.blocks if len(text) > 2 * links}
        within = [0] * len(scores)
        for i, text, links in self.blocks:
            within[i] += max(0, len(text) - 2 * links)
        for i in range(len(within) - 1, 0, -1):
            within[self.parents[i]] += within[i]
        up = c
        while up >= 0:
            c, up = up if self.declared[up] else c, self.parents[up]
        alone, up = not self.declared[c], self.parents[c]
        while up >= 0:
            if up in own or (alone and within[up] >= (1 + ADDS) * within[c]):
                c = up
            up = self.parents[up]
        return c

    def votes(self) -> dict[str, float]:
        """The page's vote for a path."""
        c = self.best()
        return {} if c is None else {self.paths[c]: 1.0}

    def held(self) -> set[str]:
        """Paths of the containers that hold text."""
        out: set[str] = set()
        for c in {c for c, _, _ in self.blocks}:
            while c >= 0 and self.paths[c] not in out:
                out.add(self.paths[c])
                c = self.parents[c]
        return out

    def texts(self, path: str | None) -> tuple[str, str | None, str | None]:
        """The main text by the host's path; where the page's own best container stands apart from it, that one's path and the text of both, in page order.

        A page without text on the host's path has its own container's; so has one that declares its article where what is on the host's path is none.
        """
        best = self.best()
        usual, mine = [False] * len(self.paths), [False] * len(self.paths)
        for i, p in enumerate(self.paths):
            up = self.parents[i]
            usual[i] = p == path or (up >= 0 and usual[up])
            mine[i] = i == best or (up >= 0 and mine[up])
        if best is None or usual[best]:
            return self._joined(usual), None, None
        declared = self.declared[best] and not any(d and u for d, u in zip(self.declared, usual, strict=True))
        if declared or not any(usual[c] for c, _, _ in self.blocks):
            return self._joined(mine), None, None
        return self._joined(usual), self.paths[best], self._joined([a or b for a, b in zip(usual, mine, strict=True)])

    def _joined(self, inside: list[bool]) -> str:
        return "\n".join(t for c, t, _ in self.blocks if inside[c])


def path_votes(pages: DataFrame, host: str, html: str) -> DataFrame:
    """host, path, votes (of the pages whose best container it is) and seen (the pages on which it holds text)."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            total: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0])
            for h, html in zip(x["host"], x["html"], strict=True):
                page = Page(html or "")
                for path, share in page.votes().items():
                    total[h, path][0] += share
                for path in page.held():
                    total[h, path][1] += 1
            yield pd.DataFrame([(*k, round(v * 1e6), n) for k, (v, n) in total.items()], columns=["host", "path", "votes", "seen"])

    votes = pages.where(F.col(host) != "").select(F.col(host).alias("host"), F.col(html).alias("html")).mapInPandas(vote, "host string, path string, votes long, seen long")
    return votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("seen").alias("seen")).where("votes > 0")


def winning_paths(votes: DataFrame) -> DataFrame:
    """host and the path that won its pages' votes; of equal ones the first by name."""
    # The least of (-votes, path): a map-side combine leaves one row a host and task.
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each whole html in column `out` (a clashing one is replaced).

    Character references are decoded, white space within a block becomes one space, blocks are joined in page order by a line feed.
    Null html is empty and gives an empty text; a page whose url is null or without a host is judged alone. Truncated and unclosed
    markup is parsed as far as it goes. Repeated pages get equal texts; an empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c != out]
    n = unused(pages, "_host", "_path", "_texts", "_own", "_doubt")
    name, path, texts, own, doubt = n.values()
    rows = pages.select(*kept, host_of(F.col(url).cast("string")).alias(name))
    votes = materialize(path_votes(rows, name, html), "paths")
    won = winning_paths(votes).select(F.col("host").alias(name), F.col("path").alias(path))
    rows = rows.join(F.broadcast(won) if won.count() <= BROADCAST_HOSTS else won, name, "left")

    @F.pandas_udf("main string, own string, both string")
    def texts_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, paths in batches:
            yield pd.DataFrame([Page(h or "").texts(p) for h, p in zip(pages, paths, strict=True)], columns=["main", "own", "both"], dtype=object)

    # A page's own container counts beside the host's path unless most pages that have one on its path hold their article elsewhere.
    doubted = votes.where(F.col("votes") < 500_000 * F.col("seen")).select(F.col("host").alias(name), F.col("path").alias(own), F.lit(True).alias(doubt))
    told = rows.withColumn(texts, texts_of(F.col(html).cast("string"), F.col(path))).withColumn(own, F.coalesce(F.col(texts)["own"], F.lit("")))
    told = told.join(F.broadcast(doubted) if doubted.count() <= BROADCAST_HOSTS else doubted, [name, own], "left")
    text = F.when((F.col(own) != "") & F.col(doubt).isNull(), F.col(texts)["both"]).otherwise(F.col(texts)["main"])
    return told.select(*kept, text.alias(out))
