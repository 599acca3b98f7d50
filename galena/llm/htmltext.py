"""Main text of web pages: gradient-boosted trees score the block elements of the page's tree, and a decoding over the
tree chooses what is kept, so that no kept element lies in a dropped one.

The trees are trained on the driver, on TRAINING_PAGES generated pages (a documented bound; no page of a table is
labelled) whose layout, tags, class names and order vary; the model is some tens of KB. Features of an element: its tag, tokens of its attributes and of its
ancestors', depth, text and link density of its subtree, punctuation, place among its siblings and on the page.

Decoding: each element is kept whole, dropped whole, or open, which leaves the choice to its children; two ensembles
give the probabilities. The likeliest consistent choice for the page is found bottom-up and read off top-down.

Text: character references are decoded, white space within a block becomes one blank, blocks are joined by a line feed.
A line break element is white space, inline elements are transparent, as are object and the elements of math.

Defined cases: null and empty pages and pages without text give an empty text; unclosed, unopened and unknown elements
are taken as browsers do, roughly; repeated rows give repeated results; pages of any length and depth are parsed whole, each in one task; of equally
likely choices for an element keeping comes before dropping, and dropping before leaving it open; other columns are kept by ``extract`` (its own columns
replace those of the same name); empty tables give empty results.
"""

from __future__ import annotations

import functools
import html as references
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .boosting import Boosted
from .common import bounded_batches, slices

TRAINING_PAGES = 700
SLICE_CHARS = 2 << 20

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*?)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements whose text a browser doesn't show as text of the page: dropped to their end tag, or else to the end of their parent.
UNSEEN = {"noscript", "template", "svg", "select", "canvas", "audio", "video"}
UNSEEN_TAG = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in UNSEEN}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var button object".split())
INLINE |= set("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mspace mpadded mphantom menclose merror maction semantics annotation annotation-xml".split())
#: Start tags that end an open p.
ENDS_P = set("address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

TAGS = [{"nav", "menu"}, {"header"}, {"footer", "address"}, {"aside"}, {"article", "main"}, {"section"}, {"div"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"form", "fieldset", "dialog"}, {"blockquote", "pre"}, {"figure", "figcaption"}, {"body", "html"}]
#: Classes of words in class, id, role and itemprop.
TOKENS = [
    set("article content main post entry story body text prose articlebody maincontent".split()),
    set("nav navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager topbar navbar skip".split()),
    set("header footer masthead banner top bottom copyright legal colophon contentinfo site branding logo".split()),
    set("sidebar side aside widget rail related recommended more complementary tags trending popular".split()),
    set("ad ads advert advertisement adbox sponsor sponsored promo promotion commercial outbrain taboola".split()),
    set("cookie cookies consent notice alert popup modal gdpr overlay dialog warning disclaimer".split()),
    set("form search login subscribe newsletter signup register contact".split()),
    set("share sharing social follow tools byline meta".split()),
    set("comment comments commentlist reply replies discussion disqus respond thread reader".split()),
]


class Node:
    __slots__ = ("tag", "parent", "depth", "kinds", "hidden", "mark", "nth", "children", "texts", "start", "chars", "links", "words", "stops", "tags", "runs")

    def __init__(self, tag, parent, kinds=(), hidden=False, mark=None):
        self.tag, self.parent, self.kinds, self.hidden = tag, parent, kinds, hidden
        self.depth = parent.depth + 1 if parent else 0
        self.mark = mark if mark is not None else (parent.mark if parent else "0")
        self.nth = len(parent.children) if parent else 0
        self.children, self.texts, self.start = [], [], 0
        self.chars = self.links = self.words = self.stops = self.tags = self.runs = 0
        if parent:
            parent.children.append(self)


def kinds_of(attributes: str) -> tuple[tuple, bool, str | None]:
    """Token classes of an element's attributes, whether it is hidden, and the training mark."""
    found, hidden, mark = set(), False, None
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-component"):
            for w in WORD.findall(value):
                w = w.lower()
                found.update(i for i, words in enumerate(TOKENS) if w in words)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif name == "data-mark":
            mark = value
    return tuple(found), hidden, mark


def parse(page: str) -> list[Node]:
    """The block elements in page order. A node's texts are (place, text) of the runs of text directly in it."""
    root = Node("html", None)
    nodes, stack, n_open = [root], [root], {}
    run: list[str] = []
    anchors = place = at = 0
    linked = [0]

    def flush():
        nonlocal place
        if run:
            text = " ".join(references.unescape("".join(run)).split())
            run.clear()
            if text:
                node = stack[-1]
                node.texts.append((place, text))
                place += 1
                node.chars += len(text)
                node.links += min(linked[0], len(text))
                node.words += text.count(" ") + 1
                node.stops += sum(text.count(c) for c in ".!?,;:。、！？")
                node.runs += 1
        linked[0] = 0

    def pop_to(tags, barrier):
        """Close the innermost open element of these tags, if no barrier comes first."""
        if not any(n_open.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for x in stack[i:]:
                    n_open[x.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return

    def within(tag, closing, empty) -> bool:
        """Does a tag belong to the unseen element? If not, the element has ended with its parent."""
        if closing:
            if tag in unseen:
                del unseen[len(unseen) - 1 - unseen[::-1].index(tag) :]
                return True
            return not (tag in INLINE or n_open.get(tag) or tag == "html")
        above = stack[-1].tag
        if not closed and (tag in ENDS_P and (above == "p" or unseen[0] == "svg") or above in CLOSES.get(tag, ()) and not BARRIER.get(tag, set()) & set(unseen)):
            return False
        if not empty and tag not in VOID:
            unseen.append(tag)
        return True

    unseen: list[str] = []  # an unseen element and the elements open in it
    closed = False  # whether its end tag comes before another of its kind
    lower_page = None
    while m := TAG.search(page, at):
        if m.start() > at and not unseen:
            piece = page[at : m.start()]
            run.append(piece)
            if anchors:
                linked[0] += len(piece)
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag, closing, rest = tag.lower(), m[1], m[3]
        if tag in RAW and unseen[:1] != ["svg"]:
            if not closing and not rest.endswith("/"):
                lower_page = page.lower() if lower_page is None else lower_page
                end = lower_page.find(f"</{tag}", at)
                at = len(page) if end < 0 or len(lower_page) != len(page) else end
                if len(lower_page) != len(page):  # lower-casing changed lengths: look for it as it is written
                    found = re.compile(f"</{tag}", re.I).search(page, m.end())
                    at = found.start() if found else len(page)
            continue
        if unseen:
            if within(tag, closing, rest.endswith("/")):
                continue
            unseen.clear()
        if tag in UNSEEN:
            if not closing and not rest.endswith("/"):
                unseen.append(tag)
                other = UNSEEN_TAG[tag].search(page, at)
                closed = bool(other and other[1])
            continue
        if tag in INLINE:
            if tag == "a":
                anchors = 0 if closing else 1
            stack[-1].tags += 1
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        anchors = 0
        if closing:
            pop_to({tag}, ())
            continue
        if tag in ("html", "head"):
            continue
        if n_open.get("p"):
            pop_to({"p"}, {x for x in ("div", "section", "article", "td", "th", "li", "blockquote", "aside", "main")})
        if tag in CLOSES:
            pop_to(CLOSES[tag], BARRIER.get(tag, ()))
        kinds, hidden, mark = kinds_of(rest) if rest.strip() else ((), False, None)
        node = Node(tag, stack[-1], kinds, hidden, mark)
        node.start = place
        nodes.append(node)
        stack.append(node)
        n_open[tag] = n_open.get(tag, 0) + 1
    if at < len(page) and not unseen:
        run.append(page[at:])
    flush()
    return nodes


N_TAGS, N_TOKENS = len(TAGS), len(TOKENS)
TAG_NUMBER = {t: i for i, tags in enumerate(TAGS) for t in tags}


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each node; the text in its subtree; the share of it that is marked."""
    n = len(nodes)
    number = {id(x): i for i, x in enumerate(nodes)}
    parent = np.array([number[id(x.parent)] if x.parent else 0 for x in nodes])
    own = np.array([[x.chars, x.links, x.words, x.stops, x.tags + 1, x.runs, x.chars * (x.mark == "1")] for x in nodes], float)
    total = own.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        total[parent[i]] += total[i]
    page = max(total[0, 0], 1)
    chars, links, words, stops, tags, runs, marked = total.T
    tag_of = np.zeros((n, N_TAGS + 1))
    token_of = np.zeros((n, N_TOKENS + 1))
    tag_above, token_above = tag_of.copy(), token_of.copy()
    same = np.zeros(n)
    for i, x in enumerate(nodes):
        tag_of[i, TAG_NUMBER.get(x.tag, N_TAGS)] = 1
        for k in x.kinds:
            token_of[i, k] = 1
        token_of[i, N_TOKENS] = x.hidden
        if i:
            p = parent[i]
            tag_above[i] = np.maximum(tag_above[p], tag_of[p])
            token_above[i] = np.maximum(token_above[p], token_of[p])
            same[i] = x.nth and x.parent.children[x.nth - 1].tag == x.tag
    before = np.concatenate([[0], np.cumsum(own[:, 0])[:-1]])
    siblings = np.array([len(x.parent.children) if x.parent else 1 for x in nodes], float)
    nth = np.array([x.nth for x in nodes], float)
    numbers = [
        np.minimum([x.depth for x in nodes], 30), np.log1p(chars), np.log1p(own[:, 0]), links / np.maximum(chars, 1), np.log1p(tags), chars / tags,
        stops / np.maximum(words, 1), words / np.maximum(runs, 1), before / page, chars / page, nth / np.maximum(siblings - 1, 1), np.log1p(siblings), same,
        chars / np.maximum(chars[parent], 1), (links / np.maximum(chars, 1))[parent], chars[parent] / page, own[:, 0] / np.maximum(chars, 1), chars / np.maximum(words, 1),
    ]
    above = tag_above[:, [0, 1, 2, 3, 4, 9, 12]]
    return np.column_stack([*numbers, tag_of[:, :N_TAGS], above, token_of, token_above]), chars, marked / np.maximum(chars, 1)


def decode(nodes: list[Node], chars: np.ndarray, whole: np.ndarray, none: np.ndarray) -> list[str]:
    """The kept blocks in page order: the likeliest consistent choice of kept, dropped and open elements. whole, none: log
    odds that all of an element's text is main text, and that none is."""
    n = len(nodes)
    number = {id(x): i for i, x in enumerate(nodes)}
    p, q = 1 / (1 + np.exp(-whole)), 1 / (1 + np.exp(-none))
    total = np.maximum(p + q, 1)
    p, q, some = p / total, q / total, chars > 0
    keep, drop, open_ = (np.where(some, np.log(np.clip(v, 1e-3, 1)), 0.0) for v in (p, q, 1 - p - q))
    inner = np.array([any(chars[number[id(c)]] > 0 for c in x.children) for x in nodes])
    for i in range(n - 1, 0, -1):
        at = number[id(nodes[i].parent)]
        keep[at] += keep[i]
        drop[at] += drop[i]
        open_[at] += max(keep[i], drop[i], open_[i] if inner[i] else -np.inf)
    state, out = ["open"] * n, []
    for i, x in enumerate(nodes):
        above = state[number[id(x.parent)]] if x.parent else "open"
        if above != "open":
            state[i] = above
        elif x.parent:
            best = max(keep[i], drop[i], open_[i] if inner[i] else -np.inf)
            state[i] = "keep" if keep[i] == best else "drop" if drop[i] == best else "open"
        if state[i] == "keep" or state[i] == "open" and p[i] > q[i]:
            out += x.texts
    return [t for _, t in sorted(out)]


# -- training pages -----------------------------------------------------------------------------------------------


def training_page(rng: random.Random) -> str:
    """A generated page; data-mark tells the article's elements (1) from others (0)."""
    syllables = ["ka", "ne", "tor", "il", "us", "ben", "dra", "mi", "so", "el", "qu", "ont", "ar", "vé", "ñu", "ße", "ing", "er", "th", "la"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    mark_ends = rng.choice([".", ".", ".", "!", "?", "!!", ".***", "%%%"])
    sentence = lambda a=4, b=18: " ".join(word() for _ in range(rng.randrange(a, b))).capitalize() + rng.choice([".", ".", mark_ends])
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.randrange(a, b)))
    plain = rng.random() < 0.35  # class names that say nothing
    vague = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))

    def attribute(*names, always=0.7):
        if plain or rng.random() > always:
            return f' class="{vague()}"' if rng.random() < 0.4 else ""
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}{rng.choice(["", "", "-" + vague(), " " + vague()])}"'

    link = lambda: f'<a href="/{word()}">{rng.choice([word(), word() + " " + word(), sentence(2, 6)])}</a>'
    close = lambda t: "" if t in ("p", "li") and rng.random() < 0.2 else f"</{t}>"

    def links(a=3, b=10):
        n = rng.randrange(a, b)
        if rng.random() < 0.7:
            t = rng.choice(["ul", "ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{link()}{close('li')}" for _ in range(n)) + f"</{t}>"
        return rng.choice([" | ", " ", " · "]).join(link() for _ in range(n))

    def boiler(kind):
        inner = {
            "nav": lambda: links(), "header": lambda: f"<a href='/'>{word()}</a>" + (f"<p>{sentence(2, 7)}</p>" if rng.random() < 0.5 else "") + (links(2, 6) if rng.random() < 0.5 else ""),
            "footer": lambda: rng.choice([f"&copy; {word()}.example &middot; {sentence()}", f"<p>{prose(1, 3)}</p>" + links(2, 6), links() + f"<p>&copy; {word()}</p>"]),
            "aside": lambda: f"<h3>{word()}</h3>" + rng.choice([links(), f"<p>{prose(1, 3)}</p>", "".join(f"<p>{link()}</p>" for _ in range(4))]),
            "ad": lambda: rng.choice([sentence(), prose(1, 3), f"<p>{prose(1, 2)}</p>", f"<a href='x'>{sentence()}</a>", f"<p>{sentence()}</p><a href='/b'>{word()}</a>"]),
            "notice": lambda: rng.choice([f"<p>{prose(1, 4)}</p><button>OK</button>", prose(1, 3) + f" {link()}", f"<div><p>{sentence()}</p>{link()}</div>"]),
            "form": lambda: f"<label>{word()}</label><input name=q><p>{sentence(2, 8)}</p><select><option>{word()}</option></select><button>{word()}</button>",
            "share": lambda: links(2, 6),
            "comments": lambda: f"<h3>{rng.randrange(90)} {word()}</h3>" + "".join(rng.choice([f"<div{attribute('comment', 'reply')}><b>{word()}</b> <p>{prose(1, 4)}</p></div>", f"<li{attribute('comment')}><p>{prose(1, 4)}</p></li>", f"<p><b>{word()}:</b> {prose(1, 3)}</p>"]) for _ in range(rng.randrange(1, 7))),
        }[kind]()
        own = {"nav": ["nav", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div"], "form": ["form", "form", "div"], "comments": ["section", "div", "ul", "aside"]}.get(kind, ["div", "div", "aside", "section", "p"] if kind == "ad" else ["div", "div", "section"])
        names = {"nav": ["nav", "menu", "breadcrumb", "navbar"], "header": ["header", "masthead", "site-header"], "footer": ["footer", "site-footer", "copyright"], "aside": ["sidebar", "related", "widget", "trending"], "ad": ["ad", "ads", "advert", "sponsored", "promo"], "notice": ["cookie-notice", "notice", "consent", "alert", "popup"], "form": ["search", "newsletter", "signup", "login"], "share": ["share", "social"], "comments": ["comments", "replies", "discussion"]}[kind]
        t = rng.choice(own)
        weak = t in ("div", "section", "p")
        if weak and not plain:
            return f'<{t} class="{rng.choice(names)}" data-mark="0">{inner}</{t}>'
        return f"<{t}{attribute(*names)} data-mark=\"0\">{inner}</{t}>" if not (weak and kind in ("ad", "notice", "comments")) else f'<{t} class="{rng.choice(names)}" data-mark="0">{inner}</{t}>'

    def block():
        r = rng.random()
        if r < 0.72:
            text = prose(1, 7) if rng.random() < 0.85 else sentence(1, 4)
            if rng.random() < 0.2:
                text = f"<b>{text}" + rng.choice(["</b>", "", "<br>"])
            if rng.random() < 0.2:
                text += f" {link()} {sentence()}"
            t = "p" if rng.random() < 0.9 else "div"
            return f"<{t}>{text}{close('p') if t == 'p' else '</div>'}"
        if r < 0.8:
            return f"<h{rng.randrange(2, 5)}>{sentence(1, 7)}</h2>".replace("</h2>", "</h2>")
        if r < 0.88:
            t = rng.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{sentence()}{close('li')}" for _ in range(rng.randrange(2, 7))) + f"</{t}>"
        if r < 0.94:
            return f"<blockquote>{rng.choice([prose(1, 3), f'<p>{prose(1, 3)}</p>'])}</blockquote>"
        if r < 0.97:
            return "<table>" + "".join(f"<tr><td>{word()}<td>{sentence(1, 5)}</tr>" for _ in range(rng.randrange(2, 5))) + "</table>"
        return f"<pre>{sentence()}\n  {sentence()}</pre>"

    body = ([f"<h1>{sentence(3, 12)}</h1>"] if rng.random() < 0.8 else []) + [block() for _ in range(rng.choice((1, 1, 1, 2, 3, 5, 8, 12, 20)))]
    for kind in ("ad", "share", "aside", "form", "comments", "notice"):
        if rng.random() < 0.18:
            body.insert(rng.randrange(1, len(body) + 1) if kind != "comments" else len(body), boiler(kind))
    t = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
    article = f"<{t}{attribute('article', 'content', 'post-body', 'entry-content', 'main', 'story')} data-mark=\"1\">" + "".join(body) + f"</{t}>"
    if t == "td":
        article = f"<table><tr><td data-mark=\"0\">{links()}</td>{article}</tr></table>"
    for _ in range(rng.randrange(0, 3)):
        article = f"<div{attribute('wrapper', 'container', 'content', 'main', 'page', always=0.4)}>" + (boiler("aside") if rng.random() < 0.2 else "") + article + (boiler(rng.choice(["aside", "comments", "ad"])) if rng.random() < 0.3 else "") + "</div>"
    top = [boiler(k) for k in ("nav", "header", "notice", "ad", "form") if rng.random() < 0.5]
    low = [boiler(k) for k in ("comments", "aside", "footer", "ad", "notice") if rng.random() < 0.5]
    rng.shuffle(top)
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>" + "".join(top) + article + "".join(low) + "</body></html>"


@functools.lru_cache(maxsize=1)
def model(pages: int = TRAINING_PAGES, seed: int = 5) -> tuple[Boosted, Boosted]:
    """Trees for: all of an element's text is main text, and: none of it is."""
    rng = random.Random(seed)
    rows, shares, weights = [], [], []
    for _ in range(pages):
        x, chars, share = features(parse(training_page(rng)))
        some = chars > 0
        rows.append(x[some])
        shares.append(share[some])
        weights.append(np.log1p(chars[some]) / some.sum() * 10)
    x, share, weight = np.concatenate(rows), np.concatenate(shares), np.concatenate(weights)
    return Boosted.fit(x, (share > 0.995).astype(float), weight), Boosted.fit(x, (share < 0.005).astype(float), weight)


def main_text(pages: list[str], trees: tuple[Boosted, Boosted]) -> list[str]:
    parsed = [parse(p) for p in pages]
    found = [features(nodes) for nodes in parsed]
    if not found:
        return []
    ends = np.cumsum([len(n) for n in parsed])[:-1]
    x = np.concatenate([x for x, _, _ in found])
    whole, none = (np.split(t.score(x), ends) for t in trees)
    return ["\n".join(decode(nodes, chars, w, z)) for nodes, (_, chars, _), w, z in zip(parsed, found, whole, none, strict=True)]


def extract(pages: DataFrame, html: str = "html", keep_html: bool = True) -> DataFrame:
    """The pages with text and n_chars."""
    bounded_batches(pages.sparkSession)
    trees = model()  # goes with the function to the workers
    pages = pages.drop(*({"text", "n_chars"} - {html}))
    columns, names = pages.columns, [c for c in pages.columns if keep_html or c != html]
    place = columns.index(html)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in slices(texts, SLICE_CHARS):
                out = main_text(texts[a:b], trees)
                own = [batch.column(columns.index(c)).slice(a, b - a) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*names, "text", "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in names), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.mapInArrow(run, schema)
