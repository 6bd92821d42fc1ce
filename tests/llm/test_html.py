"""HTML rendering: expected layouts, and properties that hold for any input."""

import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from argil.llm.html_text import extract, to_text

CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>One<p>Two", "One\n\nTwo"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<h1>T</h1>x<hr>y", "T\n\nx\n\ny"),
    ("<b>bold <i>x</b> y</i> z", "bold x y z"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a<li>b<li value=20>c</ol>", " 9. a\n10. b\n20. c"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<dl><dt>T<dd>D</dl>", "T\n  D"),
    ("<blockquote>q</blockquote>r", "  q\n\nr"),
    ("<pre>\n a\n   b</pre>c", " a\n   b\n\nc"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apples<td>12<tr><td colspan=2>a wide cell<tr><td>x<td>1</table>", "Name    Qty\nApples  12\na wide cell\nx       1"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><caption>C</caption><tr><td>a<br>b<td>c</table>", "C\na  c\nb"),
    ("<table><tr><td>a<td><table><tr><td>n<td>m<tr><td>o</table></table>", "a  n  m\n   o"),
    ("<table><tr>loose<td>cell</table>", "loose\ncell"),
    ("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>", "日本  x\nabcd  y"),
    ("<p hidden>no</p><p>yes", "yes"),
    ("<p style='color:red; DISPLAY : none'>no</p>yes", "yes"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<script>if(a<b)'</p>'</script><style>p{}</style><title>t</title>x", "x"),
    ("<head><title>t</title><meta charset=x><p>body", "body"),
    ("<template><p>no</template><noscript>no</noscript>yes", "yes"),
    ("<details><summary>S</summary>no</details><details open><summary>S</summary>yes</details>", "S\nS\nyes"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<select><option>a<option selected>b</select>", "b"),
    ("<input value=v><input type=hidden value=no><input type=submit value=go>", "v go"),
    ("<textarea>\n a  b</textarea>", " a  b"),
    ("a &lt; b &amp c &copy; &nosuch; &#65;&nbsp;d", "a < b & c © &nosuch; A d"),
    ("a < b <3 c", "a < b <3 c"),
    ("a<!-- > -- no -->b<!doctype html>c<?x?>d</>e</ x>f", "abcdef"),
    ("<a title='x>y' href=\"a'b>c\">link</a>", "link"),
    ("x<p", "x"),
    ("x<!-- never ends", "x"),
    ("<script>never ends", ""),
    ("<td>stray<td>cells", "stray cells"),
    ("a</p>b", "a\n\nb"),
    ("<q>said</q>", "“said”"),
    ("<span>a</span> <span>b</span><span> c</span>", "a b c"),
    ("<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>T</h1><p><b>x<br><p>y</article><footer>&copy; z</footer>", "- Home\n\nT\n\nx\n\ny\n\n© z"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_layout(html, text):
    assert to_text(html) == text


class Slow(HTMLParser):
    """All text outside hidden elements, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "head")
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "head")
        self.out.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


WORDS = st.lists(st.sampled_from(["alpha", "beta", "&amp;", "&lt;b", "ünï", "9"]), max_size=4).map(" ".join)


def element(inner):
    tag = st.sampled_from(["p", "div", "b", "ul", "li", "table", "tr", "td", "h2", "pre", "section", "span", "blockquote", "ol", "script"])
    return st.builds(lambda t, parts: f"<{t}>" + " ".join(parts if t != "script" else parts[:0]) + f"</{t}>", tag, st.lists(inner, max_size=4))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.recursive(WORDS, element, max_leaves=20), max_size=4).map(" ".join))
def test_no_word_is_lost(html):
    slow = Slow()
    slow.feed(html)
    slow.close()
    marks = lambda t: sorted(x for x in re.findall(r"[^\s]+", t) if not re.fullmatch(r"-|\d+\.", x))
    assert marks(to_text(html)) == marks("".join(slow.out))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "</", "/", "p", "table", "td", "li", "b", "a", '"', "'", "=", "!", "--", "x", " ", "\n", "&", "script", "pre", "select", "option", "hidden", "ol", "caption"]), max_size=60).map("".join))
def test_any_input(html):
    assert isinstance(to_text(html), str)


def test_hostile_depth():
    assert to_text("<div>" * 20000 + "x") == "x"
    assert to_text("<table><tr><td>" * 500 + "x") == "x"
    assert "x" in to_text("<ul><li>" * 500 + "x")
    assert to_text('<a "' * 20000) == ""
    assert to_text("<td colspan=999999999>a<td rowspan=99999999999>b") == "a b"
    assert to_text("<table><tr><td>" + "w" * 5000 + "<td>b" + "<tr><td>c<td>d" * 3 + "</table>").count("\n") == 3


@pytest.mark.parametrize(
    "html",
    [
        "<i><div>" * 62500 + "</i>" * 125000,
        "<table><tr>" + "<td>x" * 100_000,
        "<table><tr><td rowspan=65534 colspan=1000>a" + "<tr><td>b" * 50_000,
        "<table><tr><td>" + "x<br>" * 100_000 + "<td>y" * 100_000,
        "<table>" + ("<tr>" + "<td colspan=1000>x" * 60 + "<td>y") * 500,
        "<blockquote>x" * 50_000,
        "<br>" * 100_000 + "x",
    ],
)
def test_linear(html):
    began = time.process_time()
    out = to_text(html)
    assert time.process_time() - began < 5
    assert len(out) < 20 * len(html)
    assert out.count("x") == html.count("x") and out.count("y") == html.count("y")


def test_pages(spark):
    rows = [(1, "<p>a", "mine"), (2, None, "mine"), (3, "", None), (1, "<p>a", "mine"), (None, "<b>é", "")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = extract(pages)
    assert found.columns == ["page_id", "html", "text"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "<p>a", "a"), (2, None, None), (3, "", ""), (1, "<p>a", "a"), (None, "<b>é", "é")], key=repr)
    assert extract(pages.limit(0)).count() == 0
