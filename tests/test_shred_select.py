"""O-H1 shredder and O-H2 … O-H9 selection."""

from pyspark.sql import functions as F

from jobsift.operators import select as S
from jobsift.sources.shred import shred, shred_one

from conftest import pad, pages_df


def nodes_of(spark, html, url="https://example.com/a"):
    return shred(pages_df(spark, [(1, url, html)]))


def test_f8_selector_counts(spark):
    n = nodes_of(spark, '<div><p class="test">Hello World</p><p>Another para</p><span>Extra</span></div>')
    r = n.select(
        F.size(S.select_all(F.col("nodes"), ".test")).alias("a"), F.size(S.select_all(F.col("nodes"), "p")).alias("b"),
        S.text(F.col("buf"), S.select_one(F.col("nodes"), ".test")).alias("t"),
    ).first()
    assert (r.a, r.b, r.t) == (1, 2, "Hello World")


def test_implied_p_close_and_intervals():
    buf, nodes, err = shred_one("<p><b>One<br><p>Two</p><ul><li>a<li>b</ul>")
    assert err is None
    tags = [(n[5], n[2]) for n in nodes]
    # second <p> closes the first (and the open <b>); li closes li
    assert tags == [("p", -1), ("b", 0), ("br", 1), ("p", -1), ("ul", -1), ("li", 4), ("li", 4)]
    p1 = nodes[0]
    assert p1[1] == 2  # last descendant is the <br>
    assert buf.replace("\x00", "|").replace("\x01", "/") == "One/Two/a/b"


def test_combinators_and_attrs(spark):
    html = ('<ul class="list"><li class="x"><a href="/job-listings-1" id="job_1">A</a></li></ul>'
            '<div data-job-id="7"><span class="tag big">T</span></div><li><a href="/other">B</a></li>')
    n = nodes_of(spark, html)
    N = F.col("nodes")
    r = n.select(
        F.size(S.select_all(N, "ul.list > li")).alias("child"),
        F.size(S.select_all(N, "ul a")).alias("desc"),
        F.size(S.select_all(N, "a[href*='job-listings'], [data-job-id]")).alias("union"),
        F.size(S.select_all(N, "span.tag.big")).alias("multi"),
        F.size(S.select_all(N, "a[href^='/oth']")).alias("prefix"),
        F.size(S.select_all(N, "li:nth-child(1)")).alias("nth"),
        F.size(S.find_all(N, "span", cls_re="TAG", ignore_case=True)).alias("rx"),
    ).first()
    assert r.asDict() == {"child": 1, "desc": 1, "union": 2, "multi": 1, "prefix": 1, "nth": 1, "rx": 1}


def test_text_modes(spark):
    n = nodes_of(spark, "<div id='d'><p>Line one</p><p>Line <b>two</b></p></div>")
    d = S.select_one(F.col("nodes"), "#d")
    r = n.select(S.text(F.col("buf"), d).alias("a"), S.text_sep(F.col("buf"), d, "|").alias("b"), S.inner_text(F.col("buf"), d).alias("c")).first()
    assert r.a == "Line oneLine two"
    assert r.b == "Line one|Line |two"
    assert r.c == "Line one\nLine two"


def test_script_and_entities():
    buf, nodes, _ = shred_one('<script type="application/ld+json">{"a": "&amp;"}</script><script>var x="<p>";</script><p>A &amp; B</p>')
    assert nodes[0][7] == ["type", "#text"] and nodes[0][8][1] == '{"a": "&amp;"}'
    assert buf == "A & B"


def test_supplied_pages_shred(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    n = shred(pages.where(F.length("html") >= 500))
    r = n.agg(F.count("*").alias("pages"), F.sum(F.when(F.col("shred_error").isNull(), 1).otherwise(0)).alias("ok"),
              F.sum(F.size(S.select_all(F.col("nodes"), "h1"))).alias("h1")).first()
    assert r.pages == r.ok == r.h1 == pages.count()
