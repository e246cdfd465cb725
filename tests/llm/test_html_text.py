import html.parser
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.html_text import extract_text, op10_html_text, visible_text


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<table><tr><th>Name<th>N<tr><td>pear<td>1<tr><td>fig<td>22</table>", "Name | N\npear | 1\nfig  | 22"),
        ("<table><tfoot><tr><td>sum</tfoot><tr><td>one</table>", "one\nsum"),
        ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide |   | z\na    | b | c"),
        ("<pre>\n a\n   b  \n</pre>x", " a\n   b\n\nx"),
        ("<script>var a='<p>no</p>'</script>yes<style>p{}</style>", "yes"),
        ("<p hidden>no</p><p style='DISPLAY : none'>no</p><input type=hidden value=no>yes", "yes"),
        ("<style>.ad, #x {display:none} nav{visibility:hidden}</style><div class='b ad'>no</div><p id=x>no</p><nav>no</nav>yes", "yes"),
        ("<!-- <p>no</p> -->yes<!doctype html>", "yes"),
        ("<title>no</title><body>yes", "yes"),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"),
        ("<b>bo</b>ld <i> and</i>  wide", "bold and wide"),
        ("a < b <3 </ ok", "a < b <3"),
        ("<p>a</div></p></span>b", "a\n\nb"),
        ("<blockquote>q</blockquote>r", "  q\n\nr"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"),
    ],
)
def test_pages(page, text):
    assert visible_text(page) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<div", ">", "<", "</", "'", '"', "=", "a", " ", "&lt;", "&", "<!--", "-->", "<script>", "</script>", "<pre>", "<br/>"]), max_size=40).map("".join))
def test_never_fails(page):
    visible_text(page)


def test_every_visible_word_is_emitted_once(spark, small):
    """Against a plain tag stripper: the same words, in the same order unless a table's foot moves."""

    class Strip(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")
            self.out.append(" ")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title") and self.skip > 0
            self.out.append(" ")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    words = lambda s: [w for w in re.split(r"[\s|]+", s) if w and not re.fullmatch(r"-|\d+\.", w)]
    rows = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html").collect()
    out = {r.page_id: r for r in op10_html_text(spark, small).collect()}
    assert len(out) == len(rows)
    for page_id, source in rows:
        p = Strip()
        p.feed(source or "")
        assert words(out[page_id].text) == words("".join(p.out)), page_id
        assert out[page_id].n_chars == len(out[page_id].text)


def test_hard_pages_take_no_undue_time():
    began = time.time()
    for page in ("<div>" * 50_000 + "x", "<div" * 50_000, "<table><tr><td>" * 3000, "<p>a" * 50_000, "&" * 100_000, '<a b="' * 20_000, "<td>" * 20_000, "<ul><li>" * 5000):
        visible_text(page)
    assert time.time() - began < 60


def test_wide_cells_do_not_pad_the_table():
    page = "<table>" + "<tr><td>a<td>b" * 2000 + "<tr><td>" + "x" * 100_000 + "<td>y</table>"
    assert len(visible_text(page)) < 3 * len(page)


def test_edges(spark):
    df = spark.createDataFrame([(1, "<p>a", "old"), (1, "<p>a", "old"), (None, None, None)], "page_id bigint, html string, text string")
    out = extract_text(df)
    assert out.columns == ["page_id", "text"] and sorted(map(tuple, out.collect()), key=str) == [(1, "a"), (1, "a"), (None, "")]
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        ("<style>@media print{nav,.note{display:none}} @media (max-width:600px){table{display:none}}</style><nav>a</nav><p class=note>b<table><tr><td>c</table>", "a\n\nb\n\nc"),
        ("<style>@media screen{nav{display:none}} @media print, only  Screen {.x{color:red;display:none}} p{top:0}</style><nav>no</nav><i class=x>no</i><p>yes", "yes"),
        ("<style>@media screen and (max-width:9px){nav{display:none}} @media screen{@media print{nav{display:none}}}</style><nav>yes</nav>", "yes"),
        ("<style>@import url(x.css); @supports (display:grid){nav{display:none}} @font-face{font-family:x} .ad{display:none}</style><nav>yes</nav><b class=ad>no</b>", "yes"),
        ("<style>@media print{ /* } */ a:after{content:'}'} nav{display:none} } p{content:\"{\"} #x{display:none}</style><nav>yes</nav><p id=x>no", "yes"),
        ("<style>nav{.in{display:none} color:red}</style><nav>yes</nav>", "yes"),
        ("<style media=print>p{display:none}</style><style media='screen'>b{display:none}</style><p>yes<b>no</b>", "yes"),
        ("a<xmp>\n <b>x</b> &amp;\n</xmp>b", "a\n\n <b>x</b> &amp;\n\nb"),
        ("see <svg viewBox='0 0 1 1'><title>no</title><desc>no</desc><defs><text>no</text></defs><path d='M0'/><text x=1>one</text><g><text>two <tspan>three</tspan></text></g></svg>.", "see one two three ."),
        ("so <math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation encoding=tex>no</annotation></semantics></math> holds", "so x= 1 2 holds"),
        ("<desc>yes</desc> a<text>b</text>c", "yes abc"),
        ("<table><tr><td>a<td>b |<tr><td>c<td>|<td><tr><td>|</table>", "a | b |\nc | |\n|"),
    ],
)
def test_all_visible_text_is_kept(page, text):
    assert visible_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<style>.x{display:none} .x{display:block}</style><p class=x>yes", "yes"),
        ("<style>.x{display:none!important} .x{display:block} #y{display:block}</style><p class=x id=y>no</p>yes", "yes"),
        ("<style>p{display:block} .x{display:none} #y{display:inline}</style><p class=x>no<p class=x id=y>yes", "yes"),
        ("<style>.x{display:none}</style><p class=x style='display:block'>yes</p><p style='display:block;display:none'>no</p>", "yes"),
        ("<style>.x{display:none} main .x{display:block}</style><p class=x>yes", "yes"),
        ("<style>.x{display:none} @media (min-width:9px){.x{display:block}}</style><p class=x>yes", "yes"),
        ("<style>.x{display:none} @media print{.x{display:block}}</style><p class=x>no</p>yes", "yes"),
        ("<p hidden style='display:block'>yes</p><dialog>no</dialog><dialog open>also</dialog>", "yes\n\nalso"),
        ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no<ul><li>no<li style='visibility:visible'>item</ul></div>", "yes\n\n- item"),
        ("<ol><li>a<li hidden>no<li>b</ol>", "1. a\n2. b"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td>a<td rowspan=0>b<td>x<tr><td>c<td>y</table>", "a | b | x\nc |   | y"),
        ("<table><tr><td colspan=900>a<td>b<tr><td>c<td colspan=899>d<td>e</table>", "a |   | b\nc | d | e"),
        ("<table><tr><td><pre>one\n\ntwo</pre><td>b</table>", "one | b\n\ntwo"),
        ("<ul><li><p>a</p><p>b</p><ul><li>c</ul></ul>", "- a\n\n  b\n\n  - c"),
        ("<ul><li><pre>x\n\n y</pre></ul>", "- x\n\n   y"),
    ],
)
def test_cascade_spans_and_empty_lines(page, text):
    assert visible_text(page) == text


def test_wide_and_deep_spans_take_no_undue_room():
    began = time.time()
    out = visible_text("<table>" + "<tr>" + "<td colspan=1000 rowspan=60000>a" * 3000 + "<tr><td>b" * 3000 + "</table>")
    assert time.time() - began < 30 and len(out) < 100_000


def test_hard_sheets_take_no_undue_time():
    began = time.time()
    for sheet in ("@media screen{" * 50_000, "a{" * 50_000, "/*" * 50_000, "'" * 50_000, '"\\' * 50_000, "}" * 50_000, "@media screen{a{display:none}}" * 5000):
        visible_text(f"<style>{sheet}</style>x")
    assert time.time() - began < 30
