import html
import random
from html.parser import HTMLParser

import pytest

from treesift.llm import html_blocks as H

FURNITURE = (
    "<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t='</p>';</script></head><body><header><a href=/>Site name</a><p>A slogan of the site, long enough</p></header>"
    "<nav><ul><li><a href=a>Home</a><li><a href=b>All news</a></ul></nav><div class='cookie-notice'>We use cookies on this site, do accept them.</div><!-- no --><div class=ad>Buy the best things now.</div>"
)
AFTER = (
    "<aside><h3>Most read</h3><ul><li><a>Other story</a></li></ul></aside><form><label>Mail</label><input><button>Go</button></form>"
    "<section id='comments'><h3>2 comments</h3><article class=comment><p>I do not agree at all with what is said above.</p></article></section><footer>&copy; 2024 &middot; Imprint</footer></body></html>"
)


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<h1>Ti&shy;tle</h1><p>One  two\n three.</p><p>Four</p>", "Ti\xadtle One two three. Four"),
        ("<h1>T</h1><p>a <b>b</b>c<br>d <a href=x>link words here</a> e<p>f</p>", "T a bc d link words here e f"),
        ("<p>x &lt;y&gt; &amp;amp; &#233;&eacute;&#x41; &nbsp; z</p>", "x <y> &amp; ééA z"),
        ("<p><b>never closed<br><p>second", "never closed second"),
        ("<p>one</p><div class='advert wide'>spam spam</div><p>two</p><nav>more</nav><ul><li>three</li></ul>", "one two three"),
        ("<p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"),
        ("<p>a<script>if (a < b) { x('</article>') }</script>b</p><noscript>no</noscript>", "ab"),
        ("<p class=notice>gone</p><p>stays</p><p hidden>gone</p>", "stays"),
    ],
)
def test_articles(inner, want):
    assert H.main_text(f"{FURNITURE}<article>{inner}</article>{AFTER}") == want


def test_pages_without_semantic_elements():
    long = "word " * 40
    page = f"<div><a>Home</a></div><div><a>All news</a></div><div><p>{long}</p><p>{long}</p><p>{long}</p></div><div class=footer>Imprint</div>"
    assert H.main_text(page) == (long * 3).strip()


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<html></html>") == ""
    assert H.main_text("<article>a" + "<div>" * 5000 + "b") == "a b"
    assert H.main_text("<article>" + "x<" * 20_000).startswith("x<x<")
    assert H.main_text("<article><a href=\"unclosed>text</a><p>next</p>") in ("next", "text next", '')


def test_tree_fits_its_table_and_splits():
    x, y = H.labelled()
    assert (H.accepts(x) == y).mean() > 0.97
    import numpy as np

    tree = H.grow(np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([True, True, False, False]), least=1)
    assert tree == (0, 1.5, 1.0, 0.0)


def test_query_columns_and_odd_rows(spark):
    rows = [(1, "u", "<article><p>é</p></article>", "x"), (1, "u", "<article><p>é</p></article>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, H.extract(df).collect()), key=repr) == sorted([(1, "u", "é", 1)] * 2 + [(None, None, "", 0)], key=repr)
    assert H.extract(df.limit(0)).count() == 0


PROSE = "The paper shows many things in some words and goes on for a while until it ends here."


def test_names_are_outvoted_by_words_and_links():
    inner = f"<h1>T</h1><p>{PROSE}</p><section class='related-work'><h2>Related work</h2><p>{PROSE}</p></section><p class=legal>{PROSE}</p><figure><img><figcaption class='banner-image'>A caption</figcaption></figure><div class=side-note><p>A note.</p></div><p>{PROSE}</p>"
    want = f"T {PROSE} Related work {PROSE} {PROSE} A caption A note. {PROSE}"
    assert H.main_text(f"{FURNITURE}<article>{inner}</article>{AFTER}") == want
    links = "<div class=related-posts><ul><li><a>One more story</a><li><a>Another story</a></ul></div><div class=social>Share it</div><section class=comments><p>No, not at all, and I have many words to say about it all.</p></section>"
    assert H.main_text(f"{FURNITURE}<article>{inner}{links}</article>{AFTER}") == want


def test_elements_with_visible_text():
    inner = "<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> hold.</p><object data=x><p>In <b>place</b></p></object><p>See <svg><title>no</title><text>Fig.</text></svg></p>"
    assert H.main_text(f"{FURNITURE}<article>{inner}</article>{AFTER}") == "Let x=2 hold. In place See Fig."


@pytest.mark.parametrize("size", [10, 4_000, 4_090, 4_095, 4_200, 100_000])
def test_attributes_of_any_length(size):
    page = f"<article><p data-x=\"a>b\" {'z' * size} title='c>d'>text</p><p>next</p></article>"
    assert H.main_text(page) == "text next"


def test_long_and_hostile_pages_take_linear_time():
    import time

    began = time.time()
    body = "".join(f"<p>Paragraph {i} of a long page &amp; its text.</p>" for i in range(40_000))
    assert H.main_text(f"<article>{body}</article>").startswith("Paragraph 0 of a long page & its text. Paragraph 1")
    for page in ('<a x="' * 100_000 + ">", "<article>" + "<a x=\">' " * 50_000, "<p " * 100_000 + ">", "<article>" + "<p x='\">" * 50_000, '<a b="></a c=\'>' * 30_000, "<" * 200_000):
        H.main_text(page)
    assert time.time() - began < 30


def test_random_pages_of_known_text():
    """Pages put together from blocks whose text and label are known."""
    rng = random.Random(5)
    words = "über & so < many > words of 'every' \"kind\" ½ naïve".split()

    def block(n):
        """(markup, text) of some inline content."""
        out = [rng.choice(words) for _ in range(n)]
        text, markup = " ".join(out), []
        for w in out:
            w = html.escape(w) if rng.random() < 0.7 else "".join(f"&#{ord(c)};" for c in w)
            markup.append(rng.choice(("{}", "<b>{}</b>", "<a href='x>y'>{}</a>", "<span title=\"a>b\">{}</span>", "{}<!-- no -->", "{}<script>if (a<b) '</p>'</script>")).format(w) if rng.random() < 0.2 else w)
        return rng.choice((" ", "\n ", "\t", "&nbsp;", "<br>")).join(markup), text

    for _ in range(60):
        body, want = [], []
        for _ in range(rng.randrange(1, 9)):
            markup, text = block(rng.randrange(4, 60))
            body.append(rng.choice(("<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<blockquote>{}</blockquote>", "<ul><li>{}</ul>", "<h2>{}</h2>", "<section class=background><p>{}</p></section>", "<table><tr><td>{}</td></tr></table>")).format(markup))
            want.append(text)
            if rng.random() < 0.4:
                body.append(rng.choice(("<div class='ad'>{}</div>", "<aside><p>{}</p></aside>", "<nav><a>{}</a></nav>", "<form><p>{}</p></form>", "<footer>{}</footer>", "<div class=comments><p>{}</p></div>", "<div hidden>{}</div>")).format(block(rng.randrange(1, 40))[0]))
        assert H.main_text(f"{FURNITURE}<article>{''.join(body)}</article>{AFTER}") == " ".join(want)


class PlainBlocks(HTMLParser):
    """A second cutter of blocks, over the standard parser, for pages whose tags are all closed."""

    BREAK = {"p", "div", "ul", "li", "nav", "aside", "article", "section", "h1", "h2", "footer", "header", "table", "tr", "td", "br", "main"}

    def __init__(self, page):
        super().__init__()
        self.found, self.text, self.linked, self.links, self.skip = [], "", "", 0, 0
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if self.text.split():
            self.found.append((" ".join(self.text.split()), len(self.text.split()), min(len(self.linked.split()), len(self.text.split()))))
        self.text = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "a":
            self.links += 1
        elif tag in self.BREAK:
            self.end()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        elif tag == "a":
            self.links -= 1
        elif tag in self.BREAK:
            self.end()

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            self.linked += f" {data} " if self.links else ""


def test_blocks_against_the_standard_parser():
    rng = random.Random(6)

    def element(depth):
        out = ""
        for _ in range(rng.randrange(1, 5)):
            kind = rng.random()
            if kind < 0.5 or not depth:
                out += rng.choice((" ", "\n")) + " ".join(rng.choice(("a", "b&amp;c", "é", "x &lt; y", "12")) for _ in range(rng.randrange(6))) + " "
            elif kind < 0.7:
                tag = rng.choice(("b", "i", "span", "em", "code"))
                out += f"<{tag}>w{rng.randrange(9)}</{tag}>"
            elif kind < 0.8:
                out += f"<a href='u?a>b'>link {rng.randrange(9)}</a>"
            elif kind < 0.85:
                out += "<script>var x = '<p>';</script>"
            elif kind < 0.9:
                out += "<br>"
            else:
                tag = rng.choice(("div", "section", "article", "ul", "td", "h1", "aside"))
                out += f"<{tag}>{element(depth - 1)}</{tag}>"
        return out

    for _ in range(300):
        page = f"<div>{element(4)}</div><p>{element(0)}</p>"
        assert [(b.text, b.words, b.link_words) for b in H.blocks(page)] == PlainBlocks(page).found, page
