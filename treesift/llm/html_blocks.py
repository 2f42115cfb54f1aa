"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into text blocks at its block-level tags; the markup itself, comments, scripts, styles
and other text that a browser does not show are no blocks.  Each block has its number of words, its
link density (share of words inside links) and what is known of the elements around it: whether they
are an article, a navigation or the like, and whether their class, id or role names something beside the
article, for sure (`comments`, `cookie-notice`), perhaps (`legal`, `related`) or in part only
(`related-work`, `side-note`).  A block is classified by its own features and by the words and link
densities of the blocks before and after it (Kohlschuetter et al., 2010).  The classifier is a binary
decision tree (Gini impurity) grown from the labelled pages in `LABELLED`, a small table of page
skeletons whose blocks carry their label.  Names alone decide nothing but the sure ones: a long block
under `legal` inside an article is text, a list of links under `related-posts` is not.

Of an accepted block character references are decoded and runs of white space become one space;
blocks are joined in page order by one space.  Nothing else is dropped or cut.

Markup is read leniently: an end tag closes the nearest open element of its name and all inside it, or
nothing; a `>` inside a quoted attribute value ends no tag, however long the value (unless the tag would
never end: from there on the page's quotes protect nothing); a tag without any `>` is text; unclosed
paragraphs and inline tags are of no matter; what is open at the end of the page is closed there.
Formulas, drawings and objects are read for their visible text.

Defined results: null or empty html gives an empty text; a page without an accepted block too.
Repeated rows are extracted alike.  Extra columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import ship

# Element names and their treatment.
_HIDDEN = "script style noscript template textarea title iframe canvas audio video select head datalist annotation annotation-xml desc defs metadata".split()
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "svg g text tspan textpath path rect circle ellipse line polyline polygon use symbol "
    "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded menclose semantics".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = {"article", "main"}
_ASIDE = {"nav", "aside", "footer", "menu", "dialog", "fieldset", "button"}
# Names that stand for something beside the article, and those that may.
_SURE = set(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adunit adsbygoogle sponsor sponsors sponsored promotion sidebar comment comments reply replies respond disqus "
    "cookie cookies cookiebar consent gdpr popup modal overlay menu nav navbar navigation menubar mainmenu submenu sitemap topbar complementary contentinfo breadcrumb breadcrumbs footer masthead sharing "
    "newsletter subscribe subscription signup login toolbar pagination pager byline".split()
)
_PERHAPS = set("banner banners promo side discussion notice notices notification alert header share social related recommended recommendations search widget tags meta legal copyright disclaimer".split())
# Parts of compound names that say nothing.
_GENERIC = set(
    "container wrapper wrap box block section area list lists item items inner outer content body text title left right top bottom main post posts article articles story stories link links button buttons "
    "bar form field group row col column unit slot zone region panel site page primary secondary thread".split()
)
_NEGATED = {"has", "with", "without", "no", "is"}
_ARTICLE = set("article content entry main post story".split())
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_ATTRIBUTES = re.compile(r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>", re.S)
_HIDDEN_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _HIDDEN}
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"\S+")

#: What is known of the elements around a block.
STATE = ("main", "aside", "form", "header", "sure", "perhaps", "part")
_NOWHERE = (False,) * len(STATE)


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    tag: str
    state: tuple[bool, ...]  # inside a main element or article; and, nearer than that, inside elements of these kinds


@cache
def _kind(name: str) -> str:
    """What one name of a class, id or role stands for: sure, perhaps, part, article or nothing."""
    parts = _NAME.findall(_HUMP.sub("-", name).lower())
    if not parts or parts[0] in _NEGATED:
        return ""
    known = [p for p in parts if p in _SURE or p in _PERHAPS]
    if known:
        if any(p not in _SURE and p not in _PERHAPS and p not in _GENERIC for p in parts):
            return "part"
        return "sure" if any(p in _SURE for p in parts) else "perhaps"
    return "article" if any(p in _ARTICLE for p in parts) else ""


def _hinted(attributes: str) -> set[str]:
    """What the class, id and role of a tag stand for."""
    if not attributes:
        return set()
    if _UNSEEN.search(attributes):
        return {"sure"}
    if "=" not in attributes:
        return set()
    return {_kind(name) for _, a, b, c in _ATTRIBUTE.findall(attributes) for name in (a or b or c).split()} - {""}


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    open_: list[tuple[str, tuple[bool, ...]]] = []  # open elements, with the state before them
    state = _NOWHERE
    pieces: list[str] = []
    link_words = links = 0
    tag, at, n, last, quotes = "", 0, len(page), page.rfind(">"), True
    endless: set[str] = set()

    def flush() -> None:
        nonlocal pieces, link_words
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                count = text.count(" ") + 1
                out.append(Block(text, count, min(count, link_words), tag, state))
            pieces, link_words = [], 0

    def add(raw: str) -> None:
        nonlocal link_words
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                link_words += len(_WORD.findall(text))

    while at < n:
        m = _TAG.search(page, at) if at <= last or "<!--" in page[at:] else None
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        rest = _ATTRIBUTES.match(page, at) if quotes else None
        if rest is None:
            end = page.find(">", at)
            if end < 0:  # a tag without an end is text
                add(page[m.start() :])
                break
            quotes, attributes, at = False, page[at:end], end + 1
        else:
            attributes, at = rest[1], rest.end()
        name, closing = name.lower(), m[1] == "/"
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
            continue
        if name in _HIDDEN_END and name != "head":
            if not closing and not attributes.endswith("/"):
                end = None if name in endless else _HIDDEN_END[name].search(page, at)
                if end is not None:
                    at = end.end()
                    continue
                endless.add(name)
                if name in ("script", "style"):
                    at = n
            continue
        hints = set() if closing else _hinted(attributes)
        beside = bool(hints - {"article"})
        if name in _INLINE and not (name == "span" and (beside or closing and any(o[0] == "span" for o in open_))):
            continue
        flush()
        if open_ and open_[-1][0] == "p" and name != "span" and not (closing and name == "p"):
            state = open_.pop()[1]  # a paragraph ends where the next block begins
        tag = "" if closing else name
        if closing:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    state = open_[i][1]
                    del open_[i:]
                    links = 0
                    break
        elif name not in _VOID and name not in ("html", "body", "head") and not (name == "p" and not beside) and not attributes.endswith("/"):
            open_.append((name, state))
            main, aside, form, header, sure, perhaps, part = state
            own = ("sure" in hints, "perhaps" in hints, "part" in hints)
            if name == "main":
                state = (True, False, False, False, *own)
            elif name == "article":  # of a sidebar, a menu or the comments it is no main article
                state = (True, aside, False, False, own[0] or sure, own[1], own[2])
            elif name in _ASIDE:
                state = (main, True, form, header, sure, perhaps, part)
            elif name == "form":
                state = (main, aside, True, header, sure, perhaps, part)
            elif name == "header":
                state = (main, aside, form, True, sure, perhaps, part)
            elif beside:
                state = (main, aside, form, header, *(a or b for a, b in zip(own, state[4:])))
            elif hints and not any(state[1:]):
                state = (True, *state[1:])
    flush()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", *STATE, "heading", "item")


def features(found: list[Block]) -> np.ndarray:
    """One row of `FEATURES` for each block."""
    own = np.array([[b.words, b.link_words / b.words] for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    near = np.hstack([own, np.vstack([edge, own])[:-1], np.vstack([own, edge])[1:]])
    flags = np.array([[*b.state, b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("li", "td", "th")] for b in found], float)
    return np.hstack([near, flags.reshape(-1, len(STATE) + 2)])


#: Page skeletons; W<n> stands for about n words, W for any number.  Blocks within <keep>...</keep> are
#: the main text.  Each is taken `DRAWS` times, with other numbers of words (seeded).
DRAWS = 24
LABELLED = (
    "<header><a href=/>W</a><nav><ul><li><a>W</a></li><li><a>W</a></li></ul></nav></header><main><h1><keep>W</keep></h1><p><keep>W</keep></p><p><keep>W</keep></p></main><footer>W</footer>",
    "<nav><ul><li><a>W</a><li><a>W</a><li><a>W</a></ul></nav><div class=ad>W</div><article><h1><keep>W</keep></h1><p><keep>W</keep><p><keep>W</keep><p><keep>W</keep></article><footer>W</footer>",
    "<article><header><h1><keep>W</keep></h1><p>W</p></header><p><keep>W</keep></p><p><keep>W</keep></p><div class='share'>W4</div><aside><h2>W</h2><p>W</p></aside><p><keep>W</keep></p></article>",
    "<div id=cookie-notice><p>W</p></div><main><article><p><keep>W</keep></p><ul><li><keep>W</keep></li><li><keep>W</keep></li></ul><section class=comments><p>W</p><p>W</p></section></article></main>",
    "<div class=header><h2>W3</h2></div><div id=content><h1><keep>W6</keep></h1><p><keep>W60</keep></p><p><keep>W48</keep></p></div><div class=sidebar><p>W40</p><a>W4</a></div><div class=footer><p>W20</p></div>",
    "<div><a>W1</a></div><div><a>W2</a></div><div><a>W2</a></div><div><p><keep>W44</keep></p><p><keep>W52</keep></p><p><keep>W31</keep></p></div><div><a>W5</a></div><div>W3</div>",
    "<table><tr><td><a>W2</a></td><td><a>W1</a></td></tr></table><div><h1><keep>W7</keep></h1><p><keep>W30</keep></p><p><keep>W25</keep></p></div><div>W2</div>",
    "<div><p><keep>W90</keep></p></div><div><a>W3</a> <a>W2</a></div><div><p><keep>W50</keep></p></div><div><a>W4</a></div>",
    "<div><a>W1</a></div><p><keep>W35</keep></p><p><keep>W18</keep></p><p><keep>W70</keep></p><div><a>W2</a></div><div class=footer>W1</div>",
    "<div><a>W6</a></div><div><p><keep>W26</keep></p><p><keep>W41</keep></p></div><p>W3</p><div class=footer><p>W14</p></div>",
    "<div><a>W2</a></div><p><keep>W38</keep></p><p><keep>W45</keep></p><p><keep>W33</keep></p><div class=copyright>W2</div>",
    "<article><h1><keep>W</keep></h1><form><p>W</p><button>W</button></form><p><keep>W</keep></p><table><tr><td><keep>W</keep></td><td><keep>W</keep></td></tr></table><div class='ad'>W</div></article>",
    "<article><p><keep>W</keep></p><blockquote><keep>W</keep></blockquote><pre><keep>W</keep></pre><h2><keep>W</keep></h2><p><a><keep>W</keep></a></p></article><aside><p>W</p></aside><form>W</form>",
    "<header><p>W</p><h1>W</h1></header><main><h1><keep>W</keep></h1><p><keep>W</keep></p><nav><a>W</a><a>W</a></nav><div class=related><ul><li><a>W</a></li></ul></div></main><footer><p>W</p></footer>",
    "<nav>W</nav><div class=notice>W</div><article><p><keep>W</keep></p></article><section id=comments><h3>W</h3><article class=comment><p>W</p></article><article class=comment><p>W</p></article></section>",
    "<main><p><keep>W</keep></p><ul><li><a><keep>W</keep></a></li><li><a><keep>W</keep></a></li></ul><dl><dt><keep>W</keep><dd><keep>W</keep></dl></main><aside><ul><li><a>W</a></li></ul></aside>",
    "<article><header><h2><keep>W</keep></h2><p>W</p></header><p><keep>W</keep></p><footer>W</footer></article><div class=comments><p>W</p></div>",
    "<div class=menu><ul><li>W</li><li>W</li></ul></div><div><p><keep>W</keep></p><h2><keep>W</keep></h2><p><keep>W</keep></p></div><div class=banner><p>W</p></div><p>W</p>",
    "<article><p><keep>W</keep></p><section class=related-work><h2><keep>W</keep></h2><p><keep>W</keep></p></section><div class=related><ul><li><a>W</a></li><li><a>W</a></li></ul></div><p class=legal><keep>W40</keep></p><p><keep>W</keep></p><p class=legal><keep>W15</keep></p></article>",
    "<main><h1><keep>W</keep></h1><figure><figcaption class=banner-image><keep>W</keep></figcaption></figure><p class=notice>W5</p><p><keep>W</keep></p><div class=side-note><p><keep>W</keep></p></div><div class=social>W4</div><p><keep>W</keep></p></main>",
    "<article><p><keep>W</keep></p><div class=disclaimer><p><keep>W50</keep></p></div><div class=tags><a>W2</a> <a>W2</a></div><div class=alert><p><keep>W35</keep></p></div><p><keep>W</keep></p><div class=alert><keep>W15</keep></div><div class=alert>W3</div><p><keep>W</keep></p><div class=ad><p>W50</p></div></article>",
    "<article><p><keep>W</keep></p><div class=header-table><ul><li><keep>W</keep></li><li><keep>W</keep></li></ul></div><div class=related-reading><ul><li><a>W</a></li><li><a>W</a></li></ul></div><section class=comments><p>W60</p><p>W50</p></section></article>",
    "<div class=topbar><a>W2</a></div><div><p><keep>W50</keep></p><p><keep>W40</keep></p></div><div class=legal><p>W30</p></div><div class=related-posts><a>W5</a><a>W6</a></div><div class=notice>W20</div>",
    "<aside><article><h3><a>W</a></h3><p>W</p></article><article><h3><a>W</a></h3><p>W</p></article></aside><article><h1><keep>W</keep></h1><p><keep>W</keep></p></article><div class=share>W3</div>",
    "<form><header>W</header><article><h1><keep>W</keep></h1><p><keep>W</keep></p><p class=meta>W5</p><p><keep>W</keep></p></article><div class=search>W2</div></form>",
    "<article><p><keep>W</keep></p><div class=discussion><p><keep>W45</keep></p><p><keep>W60</keep></p></div><div class=copyright>W5</div></article><div class=search><p>W4</p></div><div class=widget><p>W25</p></div>",
    "<article><p><keep>W3</keep></p></article>",
    "<main><p><keep>W</keep></p><p><keep>W2</keep></p></main>",
    "<nav><a>W</a></nav><article><h1><keep>W3</keep></h1><p><keep>W4</keep></p><p><keep>W2</keep></p></article>",
    "<p><keep>W40</keep></p><p><keep>W30</keep></p><p><keep>W50</keep></p>",
    "<h1><keep>W6</keep></h1><p><keep>W45</keep></p><p><keep>W35</keep></p>",
    "<div><a>W2</a></div><div><p><keep>W45</keep></p><p><keep>W35</keep></p></div>",
)


#: Labelled parts of an article, of which `ARTICLES` more pages are put together in random order, between
#: a random part of `BEFORE` and one of `AFTER`.
ARTICLES = 400
PARTS = (
    "<p><keep>W</keep></p>",
    "<p><keep>W</keep></p>",
    "<p><a><keep>W</keep></a></p>",
    "<h2><keep>W</keep></h2>",
    "<h3><a><keep>W4</keep></a></h3>",
    "<ul><li><keep>W</keep></li><li><keep>W</keep></li></ul>",
    "<ol><li><a><keep>W</keep></a></li><li><a><keep>W</keep></a></li></ol>",
    "<table><tr><td><keep>W2</keep></td><td><keep>W</keep></td></tr></table>",
    "<section class=related-work><h2><keep>W3</keep></h2><p><keep>W</keep></p></section>",
    "<p class=legal><keep>W25</keep></p>",
    "<div class=alert><p><keep>W16</keep></p></div>",
    "<p class=notice>W4</p>",
    "<div class=social>W4</div>",
    "<div class=tags><a>W2</a> <a>W2</a></div>",
    "<div class=related><ul><li><a>W</a></li><li><a>W</a></li></ul></div>",
    "<div class=related-reading><ul><li><a>W</a></li><li><a>W</a></li></ul></div>",
    "<div class=ad>W</div>",
    "<div class=ad><a>W</a></div>",
    "<section class=comments><p>W</p><p><a>W</a></p></section>",
    "<form><p>W</p><a>W</a></form>",
    "<aside><p>W</p><ul><li><a>W</a></li></ul></aside>",
    "<nav><ul><li><a>W</a></li><li>W</li></ul></nav>",
    "<footer>W <a>W</a></footer>",
)
BEFORE = ("", "<nav><ul><li><a>W</a></li><li><a>W</a></li></ul></nav>", "<header><h1>W</h1><p>W</p></header>", "<div class=ad>W</div>", "<div class=cookie-notice><p>W</p></div>")
AFTER = ("", "<footer>W</footer>", "<aside><h3>W</h3><p>W</p></aside>", "<section class=comments><article><p>W</p></article></section>")


def pages(rng: np.random.Generator) -> Iterator[str]:
    """The labelled pages."""
    for page in LABELLED:
        yield from [page] * DRAWS
    for _ in range(ARTICLES):
        head = rng.choice(("", "<h1><keep>W</keep></h1>", "<header><h1><keep>W</keep></h1><p>W</p></header>", "<header><p>W</p><h2><keep>W</keep></h2></header>"))
        inner = "".join(rng.choice(PARTS, rng.integers(1, 9)))
        tag = rng.choice(("article", "main"))
        yield f"{rng.choice(BEFORE)}<{tag}>{head}{inner}</{tag}>{rng.choice(AFTER)}"


@cache
def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    x, y, rng = [], [], np.random.default_rng(1)

    def words(m: re.Match) -> str:
        n = int(m[2]) * rng.uniform(0.6, 1.6) if m[2] else np.exp(rng.uniform(0, np.log(150)))
        return ("keep " if m[1] else "drop ") * max(1, round(n))

    for page in pages(rng):
        found = blocks(re.sub(r"(<keep>)?\bW(\d*)\b(?:</keep>)?", words, page))
        x.append(features(found))
        y += [b.text.startswith("keep") for b in found]
    return np.vstack(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 24):
    """A decision tree: a share of positives, or (feature, threshold, tree up to it, tree above it)."""
    share = float(y.mean())
    best = (share * (1 - share) * len(y) - 1e-9, None, None)
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            value, positive = x[order, f], np.cumsum(y[order])
            left = np.arange(1, len(y))
            ok = (value[1:] > value[:-1]) & (left >= least) & (len(y) - left >= least)
            if not ok.any():
                continue
            p, q = positive[:-1] / left, (positive[-1] - positive[:-1]) / (len(y) - left)
            impurity = np.where(ok, p * (1 - p) * left + q * (1 - q) * (len(y) - left), np.inf)
            i = int(np.argmin(impurity))
            if impurity[i] < best[0]:
                best = (impurity[i], f, (value[i] + value[i + 1]) / 2)
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@cache
def tree():
    return grow(*labelled())


def accepts(x: np.ndarray, node=None) -> np.ndarray:
    """Which rows the tree takes for main text."""
    node = tree() if node is None else node
    if not isinstance(node, tuple):
        return np.full(len(x), node >= 0.5)
    out = np.empty(len(x), dtype=bool)
    low = x[:, node[0]] <= node[1]
    out[low], out[~low] = accepts(x[low], node[2]), accepts(x[~low], node[3])
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, yes in zip(found, accepts(features(found))) if yes)


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of each row of `pages`."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = rows.mapInArrow(_text_batches, f"id {dict(rows.dtypes)['id']}, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
