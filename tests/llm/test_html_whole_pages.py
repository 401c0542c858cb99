"""No page loses its own article: stubs, names of classes and undeclared articles; scores, votes and union against a plain version over whole trees."""

import random
from collections import Counter
from html.parser import HTMLParser

from limnos.llm import html_text

ARTICLE = "".join(f"<p>Sentence {i} of an article about the lake and its water, with some words more.</p>" for i in range(18))
USUAL = "<body><div class=content><p>A usual page of this host with its own long text in the same place.</p></div></body>"


def texts(spark, pages, url="https://h.org/{}"):
    rows = [(i, url.format(i), h) for i, h in enumerate(pages)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    return {r["page_id"]: r["text"] for r in out.collect()}


def test_a_stub_on_the_hosts_path_does_not_replace_the_article(spark):
    stub = "<div class=content><p>Updated today</p></div>"
    got = texts(spark, [USUAL] * 4 + [f"<body>{stub}<div class=x>{ARTICLE}</div></body>", f"<body><article>{ARTICLE}</article><div class=content><p>{'Near it. ' * 22}</p></div></body>"])
    lines = [f"Sentence {i} of an article about the lake and its water, with some words more." for i in range(18)]
    assert got[4].split("\n") == ["Updated today", *lines]
    assert got[5].split("\n")[:-1] == lines  # both are declared


def test_a_class_name_never_empties_a_page(spark):
    got = texts(spark, [f"<body><div class='notice-board-news'>{ARTICLE}</div></body>", f"<body><div id=search-results><p>{'Found it here. ' * 9}</p></div></body>", f"<body><div class=sidebar>Aside</div><div>{ARTICLE}</div></body>"])
    assert len(got[0]) > 1300 and got[1] == ("Found it here. " * 9).strip() and "Aside" not in got[2]


def test_comments_and_teasers_within_an_article_go(spark):
    got = texts(spark, [f"<main><article>{ARTICLE}<div class='user-reviews-list'><p>I read this and liked it.</p></div></article><article class=teaser><p>More to read elsewhere on this site.</p></article></main>"])
    assert got[0].startswith("Sentence 0") and "liked" not in got[0] and "elsewhere" not in got[0]


class Tree(HTMLParser):
    """Containers and blocks of well-formed pages of div and p."""

    def __init__(self, html):
        super().__init__()
        self.nodes, self.stack, self.blocks = [("body", None)], [0], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            self.nodes.append((self.nodes[self.stack[-1]][0] + ">div" + (f".{dict(attrs)['class']}" if attrs else ""), self.stack[-1]))
            self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        if tag == "div":
            self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.blocks.append((self.stack[-1], data))

    def above(self, c):
        while c is not None:
            yield c
            c = self.nodes[c][1]

    def best(self):
        score, within = Counter(), Counter()
        for c, text in self.blocks:
            for k, up in enumerate(self.above(c)):
                score[up] += len(text) / 2**k
                within[up] += len(text)
        if not score:
            return None
        c = chosen = min(score, key=lambda i: (-score[i], i))
        own = {b for b, _ in self.blocks}
        for up in list(self.above(chosen))[1:]:
            if up in own or within[up] >= (1 + html_text.ADDS) * within[c]:
                c = up
        return c


def test_scores_votes_and_unions_equal_plain_ones(spark):
    rng = random.Random(8)

    def div(depth):
        inner = "".join(div(depth + 1) if depth < 4 and rng.random() < 0.45 else f"<p>{'w' * rng.randint(1, 60)} {rng.random()}</p>" for _ in range(rng.randint(0, 4)))
        return f"<div{rng.choice(['', ' class=a', ' class=b', ' class=c'])}>{inner}</div>"

    pages = [f"<body>{div(0)}{div(0)}</body>" for _ in range(300)]
    trees = [Tree(p) for p in pages]
    hosts = [i % 7 for i in range(len(pages))]
    votes, seen = {}, {}
    for h, t in zip(hosts, trees, strict=True):
        seen.setdefault(h, Counter()).update({t.nodes[up][0] for c, _ in t.blocks for up in t.above(c)})
        if (b := t.best()) is not None:
            votes.setdefault(h, Counter())[t.nodes[b][0]] += 1
    rows = [(i, f"https://h{h}.org/{i}", p) for i, (h, p) in enumerate(zip(hosts, pages, strict=True))]
    out = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (h, t) in enumerate(zip(hosts, trees, strict=True)):
        won = min(votes[h].items(), key=lambda x: (-x[1], x[0]))[0]
        best = t.best()
        usual = [any(t.nodes[up][0] == won for up in t.above(c)) for c, _ in t.blocks]
        mine = [any(up == best for up in t.above(c)) for c, _ in t.blocks]
        apart = best is not None and not any(t.nodes[up][0] == won for up in t.above(best))
        if apart and not any(usual):
            kept = mine
        elif apart and 2 * votes[h][t.nodes[best][0]] >= seen[h][t.nodes[best][0]]:
            kept = [a or b for a, b in zip(usual, mine, strict=True)]
        else:
            kept = usual
        assert out[i] == "\n".join(text for (_, text), k in zip(t.blocks, kept, strict=True) if k), pages[i]
