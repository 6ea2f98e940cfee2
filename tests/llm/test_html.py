"""The main text of pages: what is left out, deep pages, and an independent extractor."""

import random
import re
import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from basetrack.llm import html_text

LONG = "Long words of the article that go on and on, so that it is the page's main text. " * 4


@pytest.mark.parametrize("name", "main-menu page-footer post-share story-promo content-nav cookie-text main-header entry-meta adBox commentBody related-posts sidebar".split())
def test_out_wins_inside_the_article(name):
    page = f'<html><body><div class="post-content"><p>{LONG}</p><div class="{name}">not the article</div><section id="{name}">nor this</section><p>End.</p></div></body></html>'
    assert html_text.text_at(page, None) == f"{LONG.strip()}\nEnd."


@pytest.mark.parametrize("name", "post-content main-content content-with-sidebar article-body has-sidebar entry text main-text storyText".split())
def test_the_article_itself_stays(name):
    page = f'<html><body><div class="{name}"><h1>Title</h1><p>{LONG}</p></div><div class="footer">f</div></body></html>'
    assert html_text.text_at(page, None) == f"Title\n{LONG.strip()}"


def test_header_of_an_article_goes_and_its_heading_stays():
    page = f"<article><header><h1>Top</h1></header><h2>Heading</h2><p>{LONG}</p></article><article class=comment><p>First</p></article>"
    assert html_text.text_at(page, None) == f"Heading\n{LONG.strip()}"


@pytest.mark.parametrize("tag", ["div", "b", "p", "li", "x"])
def test_deep_pages_take_little_memory_and_time(tag):
    page = "<html><body><article>" + f"<{tag} class='a b'>" * 50_000 + "text" + "</q>" * 50_000
    tracemalloc.start()
    began = time.process_time()
    path, _ = html_text.best(page)
    assert html_text.text_at(page, path) == "text"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000 and time.process_time() - began < 60


class Plain(HTMLParser):
    """Text blocks of the only <article>, by another parser; for pages that are well formed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.line, self.out = 0, 0, [], []

    def flush(self):
        text = " ".join("".join(self.line).split())
        self.line = []
        self.out += [text] * bool(text)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in ("nav", "footer", "script", "style", "form", "aside") or dict(attrs).get("class") in ("ad", "comments"):
            self.skipped += 1
        if tag in html_text.BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.flush()
        if tag in ("nav", "footer", "script", "style", "form", "aside", "section"):  # <section> is always one of those left out here
            self.skipped -= 1
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.line.append(data)


def test_random_pages_against_another_parser():
    rng = random.Random(3)
    word = lambda: rng.choice(["plain", "w&amp;rd", "é&eacute;", "&lt;b&gt;", "x&#33;", "end."])
    words = lambda: " ".join(word() for _ in range(rng.randint(1, 12)))

    def block(depth):
        kind = rng.randrange(9)
        if kind < 3 or depth > 3:
            return f"<p>{words()} <b>{words()}</b>\n {words()}</p>"
        if kind == 3:
            return "<ul>" + "".join(f"<li>{words()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind == 4:
            return f"<{(t := rng.choice(['nav', 'footer', 'form', 'aside']))}>{words()}</{t}>"
        if kind == 5:
            return f'<section class="{rng.choice(["ad", "comments"])}"><p>{words()}</p></section>'
        if kind == 6:
            return f"<script>var x = '<p>{words()}</p>';</script><style>p {{}}</style><!-- {words()} -->"
        return f"<div>{''.join(block(depth + 1) for _ in range(rng.randint(1, 3)))}</div>"

    for _ in range(200):
        body = f"<h1>{words()}</h1><p>{LONG}</p>" + "".join(block(0) for _ in range(rng.randint(1, 8)))
        page = f"<html><head><title>{words()}</title></head><body><nav><a href=x>{words()}</a></nav><article>{body}</article><footer>{words()}</footer></body></html>"
        other = Plain()
        other.feed(page)
        assert html_text.text_at(page, None) == "\n".join(other.out)
        assert not re.search(r"[<>]\w+ class=", html_text.text_at(page, None))


def test_hosts_and_odd_rows(spark):
    page = f"<body><article><p>{LONG}</p></article></body>"
    rows = [(i, u, page) for i, u in enumerate(["http://a.org/1", "no url", None, "", "http://a.org/2", "HTTP://A.org:80/"])] + [(None, None, None), (7, "http://a.org/1", ""), (7, "http://a.org/1", "")]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "page_id long, url string, html string, host string, path int, text int")
    votes = html_text.winners(table).collect()
    assert len(votes) == 1 and votes[0]["pages"] == 5
    got = sorted((str(r["page_id"]), r["text"]) for r in html_text.query(table).collect())
    assert got == sorted((str(i), LONG.strip() if h else "") for i, _, h in rows)


def test_more_hosts_than_are_broadcast(spark, monkeypatch):
    page = "<body><div class=c{}><p>" + LONG + "</p></div><div class=d><p>more</p></div></body>"
    rows = [(i, f"http://h{i % 7 if i % 3 else 0}.org/", page.format(i % 2)) for i in range(60)] + [(99, None, page.format(1))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = sorted(map(tuple, html_text.query(table).collect()))
    monkeypatch.setattr(html_text, "MOST_SENT", 0)
    assert sorted(map(tuple, html_text.query(table).collect())) == first


def test_sections_of_an_article_keep_ordinary_words():
    own = '<section id="discussion"><h2>Discussion</h2><p>We discuss.</p></section><section class="related-work"><p>Others.</p></section><p class="popular">A popular one.</p><div><span class="social-science">Science.</span></div><div class="banner-year">A year.</div>'
    page = f"<article><p>{LONG}</p>{own}<p>End.</p></article>"
    assert html_text.text_at(page, None).split("\n")[1:] == ["Discussion", "We discuss.", "Others.", "A popular one.", "Science.", "A year.", "End."]


@pytest.mark.parametrize(
    "block",
    [
        '<div class="related"><a href=x>One</a> <a href=y>Two</a></div>',
        '<section id="discussion"><p>Nice.</p><div class="comment">I agree with all of this.</div></section>',
        '<div id="discussion">Say something <form><input></form></div>',
        '<ul class="popular"><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>',
        '<div class="popular-stories">One. Two.</div><div class="social">Tell others</div><div class="share-buttons">x</div>',
        '<article class="related">Another article.</article><div class="banner">Buy</div>',
    ],
)
def test_lists_and_readers_go_whatever_word_names_them(block):
    page = f"<article><p>{LONG}</p>{block}<p>End.</p></article>"
    assert html_text.text_at(page, None) == f"{LONG.strip()}\nEnd."


def test_a_quote_that_is_not_closed():
    assert html_text.text_at(f'<article><p>{LONG}</p><p title="a>lost</p><p>End.</p></article>', None) == f"{LONG.strip()}\nlost\nEnd."
    assert html_text.text_at(f"<article><p title='b'>{LONG}</p><p title='a", None) == LONG.strip()


def test_hosts_with_tied_votes_and_pages_without_the_path(spark):
    """Ties go to the larger score, then the larger path; a page without the host's path is read by itself; all by counting the votes in Python."""
    page = '<body><div class="{}"><p>{}</p></div><div class="{}"><p>{}</p></div></body>'
    rows = [(i, "http://a.org/x", page.format("one", LONG * (1 + i % 2), "two", LONG * (2 - i % 2))) for i in range(4)]
    rows += [(10 + i, "http://b.org/x", page.format("c", LONG, "d", "short")) for i in range(3)] + [(20, "http://b.org/y", page.format("e", LONG, "d", "short"))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = {}
    for host in ("a", "b"):
        own = [(i, h) for i, u, h in rows if f"//{host}." in u]
        votes = {}
        for _, h in own:
            path, score = html_text.best(h)
            n, total = votes.get(path, (0, 0))
            votes[path] = n + 1, total + round(score)
        winner = max((*v, p) for p, v in votes.items())[2]
        expected |= {i: html_text.text_at(h, winner) for i, h in own}
    got = {r["page_id"]: r["text"] for r in html_text.query(table).collect()}
    assert got == expected and got[20] == LONG.strip() and len({got[i] for i in range(4)}) == 2
