import html
import re

import pytest

from passlane.llm import wrapper as W

RICH = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li>menu</ul></nav><div id="cookie-notice">We use cookies</div><main><article class=post>
<header><h2>Ti&eacute;tle</h2></header><p>One <b>two<p>Three&nbsp;four<br>five <!-- <p>no</p> -->
<ul><li>x<li>y</ul><script>var a="</article>";if(a<b){}</script><form>name <input> <button>go</button></form><aside>s</aside>
<div class="comments"><article>a reader says</article></div></article></main><div class="sidebar">q</div><footer>f</footer>"""


def text(source):
    return W.Page(source).text(set())


def test_content_and_blocks():
    assert text(RICH) == "Tiétle\nOne two\nThree four five\nx\ny"
    assert text('<p>only <i>text</p><script>if(a<b){"</p>"}</script><p>second &amp;amp; last') == "only text\nsecond &amp; last"
    assert text("a < b & c <br> d<p>e</div></span>f") == "a < b & c d\ne\nf"
    assert text("<div title='a>b' class=\"x\">one</div><table><tr><td>1<td>2<tr><td>3</table>") == "one\n1\n2\n3"


@pytest.mark.parametrize("source", [None, "", "   ", "<!-- open", "<script>x", "<p", "<", "</p>", "<article></article>"])
def test_degenerate_pages(source):
    assert text(source) in ("", "<")


def test_simple_tree_matching_keeps_order_and_size():
    a, b = W.Page("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>"), W.Page("<div><p>1</p><p>2</p><ul><li>x</li><li>y</li></ul></div>")
    found = W.simple_tree_matching(a, b)
    assert len(found) == 5 and found[0] == 0  # html, div, p, ul, li: the second p cannot keep the order
    pairs = sorted((y, x) for y, x in found.items())
    assert all(a.labels[x] == b.labels[y] for y, x in pairs)
    assert len(W.simple_tree_matching(a, a)) == len(a.tags)


def test_wrapper_drops_what_a_host_repeats(spark):
    page = "<html><body><div class=x>Our motto</div><div class=y><p>{a}</p><p>{b}</p></div><div class=z>All rights, {n}</div></body></html>"
    rows = [(k, f"https://one.example/{k}", page.format(a=f"story {k}", b=f"more {k * k}", n="same")) for k in range(8)]
    rows += [(100, "https://two.example/", page.format(a="x", b="y", n="same")), (101, None, "<p>lone</p>"),
             (102, "https://one.example/e", ""), (103, "https://one.example/n", None), (3, *rows[3][1:])]
    rows += [(k, f"https://copies.example/{k}", "<p>always the same</p>") for k in range(200, 206)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).select(
        "*", *[F.lit(0).alias(c) for c in ("host", "text", "node", "template", "reference")])
    got = {r.page_id: r.text for r in W.extract_main_text(frame).collect()}
    assert W.extract_main_text(frame).count() == len(rows)
    assert all(got[k] == f"story {k}\nmore {k * k}" for k in range(8))
    assert got[100] == "Our motto\nx\ny\nAll rights, same" and got[101] == "lone" and got[102] == got[103] == ""
    assert all(got[k] == "always the same" for k in range(200, 206))
    assert W.extract_main_text(frame.limit(0)).count() == 0


def test_whole_table_against_the_articles(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in frame.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        want[r.page_id] = "\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in W.extract_main_text(frame).collect()} == want


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'title="hidden"', 'data-id="ad"', "data-x=hidden", 'data-class="nav" data-hidden'])
def test_only_whole_attribute_names_count(attributes):
    assert text(f"<article><div {attributes}><p>one</p></div><p>two</p></article>") == "one\ntwo"
    assert text('<p>see <a href="/hidden-gems">gems</a> <a href="/p?id=login">in</a></p>') == "see gems in"
    assert text('<p>a<b aria-hidden="true">x</b><i HIDDEN>y</i><u hidden=until-found>z</u></p>') == "a"


def test_deep_pages_are_matched():
    page = W.Page("<div>" + "<font>x" * 5000)
    assert len(W.simple_tree_matching(page, page)) == len(page.tags) == 5002


def test_elements_without_their_end_tag_do_not_eat_the_page():
    end = " two</p><p>three</p></article>"
    for element in ('<svg class="i"/>', "<math/>", "<svg><path d='x'/><g/><circle/></svg>", "<video src=x><source src=y></video>",
                    "<select><option>1<option>2</select>", "<svg><title>t</title><text>s</text></svg>", "<template><p>x</p></template>"):
        assert text(f"<article><p>one {element}{end}") == "one two\nthree"
    for name in ("object", "video", "audio", "canvas", "select"):
        assert text(f"<article><p>one <{name}>{end}") == "one two\nthree"
    assert text("<p>as <math><mi>x</mi><mo>=</mo><mn>1</mn></math> shows</p>") == "as x=1 shows"


def test_words_of_content_make_no_aside():
    for element in ('h2 id="related-work"', 'section id="discussion"', 'h2 id="search"', 'div class="response-text"',
                    'div id="search-algorithms"', 'p class="no-promo-text"'):
        name = element.split()[0]
        assert text(f"<article><p>a</p><{element}>b</{name}><p>c</p></article>") == "a\nb\nc"
    assert text('<article class="post category-social tag-ads"><p>a</p></article>') == "a"
    assert text('<body><div class="widget"><p>all the text of this page</p></div><p>end</p>') == "all the text of this page\nend"
    for word in ("ad", "ad-slot-1", "site-footer", "comment-list", "cookie-notice", "share-links wide", "sidebar"):
        assert text(f'<article><p>one and two</p><div class="{word}">b</div></article>') == "one and two"
    assert text('<article><p>a</p><div id="comments">long and longer remarks</div></article>') == "a"


def test_all_articles_and_the_enclosing_main_stay():
    assert text("<p>out</p><article><p>a</p></article><div><article><p>longer b</p></article></div><aside><article>x</article></aside>") == "a\nlonger b"
    assert text("<body><p>out</p><main><h1>Title</h1><p>Lead</p><article><p>long text</p></article><nav>n</nav></main>") == "Title\nLead\nlong text"


def test_a_stub_is_no_median_reference(spark):
    page = "<html><body><div class=x>Our motto</div><div class=y><p>{a}</p></div><div class=z>All rights</div></body></html>"
    rows = [(k, f"https://one.example/{k}", page.format(a=f"story {k}")) for k in range(8)]
    rows += [(8, "https://one.example/8", "x"), (9, "https://one.example/9", "<p>")]
    got = {r.page_id: r.text for r in W.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"story {k}" for k in range(8)}, 8: "x", 9: ""}
