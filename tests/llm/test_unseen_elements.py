"""Elements of pages that aren't raw text: their text, and what follows where they aren't closed."""

import pytest

from galena.llm import htmltext


def texts(page):
    return [t for _, t in sorted(x for n in htmltext.parse(page) for x in n.texts)]


@pytest.mark.parametrize("tag", sorted(htmltext.UNSEEN))
def test_end_of_unseen_elements(tag):
    assert texts(f"<div><p>a <{tag} id=x><p>no</p><b>no</b></{tag}>b</p><p>c</p></div>d") == ["a b", "c", "d"]
    assert texts(f"<article><p>a</p><div><{tag}>no</div><p>b</p></article><p>c") == ["a", "b", "c"]
    assert texts(f"<article><p>a <{tag}>no</p><p>b</p><p><{tag}>no</{tag}>c</p></article>") == ["a", "b", "c"]
    assert texts(f"<article><p>a<{tag}><p>b<p>c</article>") == ["a", "b", "c"]
    assert texts(f"<ul><li>a<{tag}><li>b</ul><p>c <a href=x><{tag}>no</a> d</p>") == ["a", "b", "c d"]
    assert texts(f"<p>a <{tag}/>b</p></{tag}>c") == ["a b", "c"]


def test_math_and_object_keep_their_text():
    assert texts("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>") == ["if x=2 then"]
    assert texts("<p>see <object data=f>the figure</object> here</p><object data=g><p>b</p>") == ["see the figure here", "b"]


def test_raw_and_nested():
    assert texts("<svg><title>no<path d='x'/></svg>a<script>if (a<b) '<p>no'</script>b") == ["ab"]
    assert texts("<video><source src=x><style>p{}</style><p>no</video>a") == ["a"]
    assert texts("<select><option>no<option>no</select>a") == ["a"]
