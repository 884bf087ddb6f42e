import time

import pyarrow.parquet as pq
import pytest

from jobsift.llm import maintext as mt

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="<p>no</p>";</script><style>p{}</style></head>
<body class="page has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-banner">We use cookies</div>
<article><header><h1>Head&shy;line &eacute; &#233; &nbsp; end</h1></header><p>First   <b>bold</b><i>italic</i> one<br>two
<p>Second &lt;tag&gt; a &amp b</p><div class="ad-slot"><p>Buy now</p></div><form><p>mail</p></form>
<ul><li>item 1<li>item 2</ul><table><tr><td>a<td>b<tr><td>c</table><p hidden>never</p><span style="display: none">x</span>
<section class="comments"><p>Reader says</p></section><footer>by me</footer></article>
<aside>Related</aside><div role="contentinfo">imprint</div><!-- <p>no</p> --></body></html>"""


def test_one_page():
    assert mt.main_text(PAGE) == "\n".join(
        ["Head\xadline é é end", "First bolditalic one two", "Second <tag> a & b", "item 1", "item 2", "a b", "c"]
    )


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<main><p>m</main><p>out", "m"), ("a<div>b</div>c", "a\nb\nc"),
        ("<p>a < b <3 c</p>", "a < b <3 c"), ("<p title='x>y'>t</p>", "t"), ('<p title="open>t</p>', ""), ("<p>x<!-- open", "x"),
        ("<p>x<script>var a = 1", "x"), ("</div></p><p>a</b></i></p>", "a"), ("<article><p>a</div><p>b</article>c", "a\nb"),
        ("<div><article><p>a</p></article></div><p>not</p>", "a"), ("<p>a<span class='advert'>b</span>c</p>", "ac"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"), ("<nav><p>x", ""), ("<P>A</P><SCRIPT>x</SCRIPT><p>b", "A\nb"),
        ("<p>a</p>\n<hr>\n<p>b</p>", "a\nb"), ("<textarea>x</textarea><p>y", "y"),
    ],
)
def test_markup(page, text):
    assert mt.main_text(page) == text


def test_time_is_linear_on_hostile_pages():
    for unit in ("<p title='", '<p a="b', "<div>", "</div>", "<b>", "<li>", "<p>", "<div><p>", "<!--", "<", "&", "<a b=c ", "<span class=ad>", "</x", "<li><div>"):
        took = []
        for n in (1 << 17, 1 << 19):
            page = unit * (n // len(unit))
            t = time.process_time()
            mt.subtrees(mt.parse(page + "text"))
            took.append(time.process_time() - t)
        assert took[1] < 10 * max(took[0], 0.05), (unit, took)


def supplied():
    return pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()


def expected(html):
    """The supplied pages have one article of a heading and paragraphs with <b> and <br> inside."""
    import html as h
    import re

    article = re.search(r"<article>(.*)</article>", html, re.S)[1]
    article = re.sub(r"<br>", " ", article)
    blocks = re.split(r"</?(?:p|h1)>", article)
    return "\n".join(x for b in blocks if (x := " ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split())))


def test_supplied_pages(spark):
    rows = supplied()
    df = spark.createDataFrame([(r["page_id"], r["url"], r["html"]) for r in rows], "page_id BIGINT, url STRING, html STRING")
    got = {r.page_id: r.text for r in mt.extract(df).collect()}
    assert got == {r["page_id"]: expected(r["html"]) for r in rows}


def test_templates_are_counted_per_host(spark):
    """An unnamed block that a host repeats goes; on another host, in copies and in rare pages it stays."""
    rows = []
    for i in range(40):
        rows.append((i, f"https://A.example/{i}", f"<body><div class='x1'>All rights of A</div><p>Text number {i} of a</p><p>more {i}</p><div>Follow us today</div></body>"))
    rows += [(100 + i, f"http://b.example/{i}", f"<body><p>Text number {i} of b</p><p>{'Follow us today' if i == 3 else i}</p></body>") for i in range(40)]
    rows += [(200 + i, f"http://c.example/{i}", "<body><p>One page</p><p>copied often</p></body>") for i in range(60)]
    rows += [(300, None, "<p>no host</p>"), (301, "http://a.example/x", None), (None, None, None), (302, "nonsense", ""), (5, "https://a.example:80/5", "<p>Follow us today</p><p>5</p>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").selectExpr("*", "'x' AS host", "1 AS tree", "2 AS text", "3 AS gone")
    got = {}
    for r in mt.extract(df).collect():
        got.setdefault(r.page_id, set()).add(r.text)
    for i in range(1, 40):
        if i != 5:
            assert got[i] == {f"Text number {i} of a\nmore {i}"}
    assert got[0] == {"Text number 0 of a\nmore 0"} and got[103] == {"Text number 3 of b\nFollow us today"} and got[200] == {"One page\ncopied often"}
    assert got[300] == {"no host"} and got[301] == got[None] == got[302] == {""}
    assert len(got) == len({r[0] for r in rows})
    assert mt.extract(df.where("false")).count() == 0


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    return {r.page_id: r.text for r in mt.extract(df).collect()}


def test_runs_of_sibling_templates_go(spark):
    """One to three unnamed blocks in a row, at the top and at the bottom; a paragraph beside them that often repeats stays."""
    rows, want = [], {}
    for k in (1, 2, 3):
        for i in range(40):
            top, bottom = ("".join(f"<div>{where} {j} of the site</div>" for j in range(k)) for where in ("Above", "Below"))
            page = 100 * k + i
            rows.append((page, f"http://run{k}.example/{i}", f"<body>{top}<p>Section {i % 4}</p><p>Text {i}</p><p>End {i % 4}</p>{bottom}</body>"))
            want[page] = f"Section {i % 4}\nText {i}\nEnd {i % 4}"
    assert extracted(spark, rows) == want


def test_an_article_copied_under_changing_templates_stays(spark):
    rows, want = [], {}
    for i in range(32):
        some = "".join(f"<div>Part {j}</div>" for j in range(5) if i >> j & 1)
        rows.append((i, f"http://d.example/{i}", f"<body><p>One article</p><p>copied often</p>{some}</body>"))
        want[i] = "One article\ncopied often"
    for i in range(32, 52):
        rows.append((i, f"http://d.example/{i}", f"<body><p>Own text {i}</p>{''.join(f'<div>Part {j}</div>' for j in range(5))}</body>"))
        want[i] = f"Own text {i}"
    assert extracted(spark, rows) == want
