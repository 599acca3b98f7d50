"""Main text on the tables' pages, on unseen generated pages, and the parts of the extraction by themselves."""

import html
import random
import re
from collections import Counter

import numpy as np

from galena.llm import htmltext, registry
from galena.llm.boosting import Boosted


def article_of(page):
    """The text of the article element of the tables' pages, by patterns."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"</?b>", "", inner.replace("<br>", " "))
    blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in blocks if x)


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = registry.QUERIES["op8_html_text"](spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)
    assert sum(r.text == article_of(pages[r.page_id].html) for r in got) >= 0.98 * len(got)


def test_unseen_pages():
    rng, trees, f1 = random.Random(20240), htmltext.model(), []
    for _ in range(100):
        page = htmltext.training_page(rng)
        want = Counter(t for n in htmltext.parse(page) if n.mark == "1" for _, t in n.texts)
        got = Counter(htmltext.main_text([page.replace(" data-mark", " data-x")], trees)[0].split("\n"))
        size = lambda c: sum(len(t) * n for t, n in c.items())
        f1.append(2 * size(got & want) / max(1, size(got) + size(want)))
    assert np.mean(f1) > 0.95


def texts(page):
    return [t for _, t in sorted(x for n in htmltext.parse(page) for x in n.texts)]


def test_parsing():
    assert texts("<p>a&amp;b &lt;c&#233; x\n y<p>z<br>w<b>v</b>u") == ["a&b <cé x y", "z wvu"]
    assert texts("<script>var a='</p><p>no'</script><style>p{}</style><title>t</title><div title='a>b'>in</div><!-- <p>no</p> -->out") == ["in", "out"]
    assert texts("<ul><li>one<li>two<ul><li>in</ul></ul><table><tr><td>1<td>2<tr><td>3</table>") == ["one", "two", "in", "1", "2", "3"]
    assert texts("</div></p>a < b & c <" + "<div>" * 3000 + "x") == ["a < b & c <", "x"]
    assert texts("") == [] and texts("<p>") == []
    li = [n for n in htmltext.parse("<ul><li>a<li>b</ul><p>c") if n.tag in ("li", "p")]
    assert [n.parent.tag for n in li] == ["ul", "ul", "html"]


def test_decoding_is_consistent():
    nodes = htmltext.parse("<body><div><p>one</p><p>two</p></div><nav>three</nav></body>")
    x, chars, _ = htmltext.features(nodes)
    by = {n.tag: i for i, n in enumerate(nodes)}
    whole, none = np.full(len(nodes), -4.0), np.full(len(nodes), -4.0)
    whole[by["div"]] = 6.0
    none[by["nav"]] = 6.0
    for i, n in enumerate(nodes):
        if n.tag == "p":  # the first paragraph looks like none by itself, but its parent is surer
            whole[i], none[i] = (0.0, 0.5) if n.nth == 0 else (3.0, -3.0)
    assert htmltext.decode(nodes, chars, whole, none) == ["one", "two"]


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text"), (3, "u", "just text"), (4, "v", "<nav><a href=x>menu</a></nav>"), (None, "w", "<p>" * 20000), (5, "w", "<div>" + "x y. " * 100000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' as text")
    out = htmltext.extract(df)
    got = out.collect()
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"] and len(got) == len(rows)
    assert all(r.text == "" and r.n_chars == 0 for r in got if not r.html)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_boosting():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = Boosted.fit(x[:1500], y[:1500], np.ones(1500), trees=40, depth=3)
    assert ((trees.score(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95
    assert len(trees.score(x[:0])) == 0
